"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from ..session import table
from .retrieval import SQL as RETRIEVAL_SQL
from .retrieval import BM25, bm25_topk, dense_topk

_HITS = RETRIEVAL_SQL["dense_topk"].replace(" SELECT * FROM hits", "")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and reciprocal rank of dense search; vectors of the query's label are relevant."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return evaluation.retrieval_metrics_by_label(q, dense_topk(spark, sf_dir), e.select(F.col("vec_id").alias("id"), "label"), "id")


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item search: mean recall at 3 and reciprocal rank of a title's own document, by document type."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0 and title is not null")
    q = d.select(F.col("doc_id").alias("query_id"), "document_type")
    m = evaluation.retrieval_metrics(q, bm25_topk(spark, sf_dir), q.select("query_id", F.col("query_id").alias("doc_id")), "doc_id")
    return m.join(q, "query_id").groupBy("document_type").agg(F.count("*").alias("queries"), F.round(F.avg("recall_3"), 6).alias("recall_3"), F.round(F.avg("mrr"), 6).alias("mrr"))


def citation_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the document types of a source's odd documents against those of its even ones."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    side = lambda r: F.collect_set(F.when(F.col("doc_id") % 2 == r, F.concat_ws("/", "document_type", "format")))
    return d.groupBy("source").agg(side(1).alias("p"), side(0).alias("e")).select("source", *evaluation.citation_prf(F.col("p"), F.col("e")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records made of documents: category, status, verdict and metrics by number."""
    d = table(spark, sf_dir, "documents").filter("document_type is not null")
    verdict = F.element_at(F.array(*map(F.lit, evaluation.VERDICTS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.col("document_type").alias("category"), F.when(F.col("doc_id") % 11 == 0, "error").otherwise("success").alias("status"), verdict.alias("verdict"), (F.col("doc_id") % 3 == 0).alias("verification_pass"), ((F.col("doc_id") % 7) / 7.0).alias("citation_f1"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 9) / 9.0).alias("mrr"), F.col("n_chars").cast("double").alias("latency_ms"))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all records and by category."""
    return evaluation.summary(_records(spark, sf_dir), ["citation_f1", "mrr", "latency_ms"])


def _values(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    status = F.when((F.col("doc_id") + shift) % 50 == 0, "error").otherwise("success")
    value = lambda k: F.when(status == "success", (((F.col("doc_id") + shift) * k) % 10) / 10.0)
    names = [("citation_precision", 1), ("citation_recall", 3), ("coverage", 7), ("accuracy", 9)]
    return d.select(F.col("doc_id").alias("question_id"), status.alias("status"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), value(k).alias("value")) for n, k in names])).alias("_m")).select("question_id", "_m.metric", "_m.value", "status")


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one run against another: aggregates, errors and catastrophic drops of single questions."""
    return evaluation.compare(_values(spark, sf_dir, 3), _values(spark, sf_dir, 0))


def baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst finding for each metric, and as lines of a table for aggregates."""
    lines = evaluation.comparison_lines(baseline_compare(spark, sf_dir).filter("scope = 'aggregate'"))
    worst = baseline_compare(spark, sf_dir).groupBy("metric").agg(F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)).alias("severity"))
    return lines.join(worst, "metric")


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' JSON, sound and broken, made of every document, read and scored."""
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"verdict": "'), F.element_at(F.array(*map(F.lit, ["correct", "PARTIAL", "UNSUPPORTED", "maybe"])), (F.col("doc_id") % 4 + 1).cast("int")), F.lit('", "reasoning": "r'), F.col("doc_id"), F.lit('"}'))).when(F.col("doc_id") % 3 == 1, F.lit("no json")).otherwise(F.lit("{}"))
    return d.select("doc_id", evaluation.judged(raw).alias("_j")).select("doc_id", F.col("_j.verdict").alias("verdict"), F.col("_j.reasoning").alias("reasoning"), evaluation.verdict_score(F.col("_j.verdict")).alias("score"))


QUERIES = {f.__name__: f for f in (retrieval_metrics, benchmark_summary, citation_prf, eval_summary, baseline_compare, baseline_status, judge_parse)}

_METRIC = """, f AS (SELECT h.query_id, h.rank, EXISTS (SELECT 1 FROM rel WHERE rel.query_id = h.query_id AND rel.id = h.id) AS good FROM ranked h), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
    g AS (SELECT query_id, min(rank) FILTER (good) AS one, sum((good AND rank <= 1)::INT) AS h1, sum((good AND rank <= 3)::INT) AS h3, sum((good AND rank <= 5)::INT) AS h5 FROM f GROUP BY query_id),
    metrics AS (SELECT query_id, round(coalesce(h1 / n, 0), 6) AS recall_1, round(coalesce(h3 / n, 0), 6) AS recall_3, round(coalesce(h5 / n, 0), 6) AS recall_5, round(coalesce(h1 / 1, 0), 6) AS precision_1, round(coalesce(h3 / 3, 0), 6) AS precision_3, round(coalesce(h5 / 5, 0), 6) AS precision_5, round(coalesce(1 / one, 0), 6) AS mrr FROM n LEFT JOIN g USING (query_id))"""
_VALUES = """v{0} AS (SELECT doc_id AS question_id, status, metric, CASE WHEN status = 'success' THEN ((doc_id + {0}) * k % 10) / 10.0 END AS value
    FROM (SELECT doc_id, CASE WHEN (doc_id + {0}) % 50 = 0 THEN 'error' ELSE 'success' END AS status FROM documents), (VALUES ('citation_precision', 1), ('citation_recall', 3), ('coverage', 7), ('accuracy', 9)) t(metric, k))"""
_COMPARE = (
    "WITH "
    + _VALUES.format(0)
    + ","
    + _VALUES.format(3)
    + """, limits AS (SELECT * FROM (VALUES ('citation_precision', 0.02, 0.05), ('citation_recall', 0.02, 0.05), ('citation_f1', 0.02, 0.05), ('coverage', 0.02, 0.05), ('accuracy', 0.05, 0.1)) t(metric, warn, fail)),
    b AS (SELECT metric, round(avg(value), 6) AS baseline FROM v0 WHERE status = 'success' AND value IS NOT NULL GROUP BY metric), c AS (SELECT metric, round(avg(value), 6) AS current FROM v3 WHERE status = 'success' AND value IS NOT NULL GROUP BY metric),
    a AS (SELECT metric, baseline, current, round(current - baseline, 6) AS delta, warn, fail FROM b JOIN c USING (metric) JOIN limits USING (metric)),
    e AS (SELECT (SELECT count(DISTINCT question_id) FROM v0 WHERE status = 'error')::DOUBLE AS baseline, (SELECT count(DISTINCT question_id) FROM v3 WHERE status = 'error')::DOUBLE AS current),
    o AS (SELECT question_id, metric, v0.value::DOUBLE AS baseline, v3.value::DOUBLE AS current, round(v3.value::DOUBLE - v0.value::DOUBLE, 6) AS delta FROM v0 JOIN v3 USING (question_id, metric) WHERE metric <> 'accuracy'),
    findings AS (SELECT metric, 'aggregate' AS scope, baseline, current, delta, CASE WHEN delta <= -fail THEN 'fail' WHEN delta <= -warn THEN 'warn' WHEN delta > 0 THEN 'info' ELSE 'ok' END AS status FROM a
    UNION ALL SELECT 'error_count', 'aggregate', baseline, current, current - baseline, CASE WHEN current - baseline > 1 THEN 'fail' WHEN current - baseline > 0 THEN 'warn' WHEN current < baseline THEN 'info' ELSE 'ok' END FROM e
    UNION ALL SELECT metric, 'per_question:' || question_id, baseline, current, delta, 'fail' FROM o WHERE delta <= -0.5)"""
)
SQL = {
    "retrieval_metrics": _HITS + ", ranked AS (SELECT query_id, id, rank FROM hits), rel AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0)" + _METRIC + " SELECT * FROM metrics",
    "benchmark_summary": BM25 + ", ranked AS (SELECT query_id, id, rank FROM hits), rel AS (SELECT doc_id AS query_id, doc_id AS id FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL)" + _METRIC + " SELECT document_type, count(*) AS queries, round(avg(recall_3), 6) AS recall_3, round(avg(mrr), 6) AS mrr FROM metrics JOIN documents ON doc_id = query_id GROUP BY document_type",
    "citation_prf": """WITH s AS (SELECT source, coalesce(list(DISTINCT concat_ws('/', document_type, format)) FILTER (doc_id % 2 = 1), []) AS p, coalesce(list(DISTINCT concat_ws('/', document_type, format)) FILTER (doc_id % 2 = 0), []) AS e FROM documents WHERE source IS NOT NULL GROUP BY source),
        n AS (SELECT source, len(p) AS p, len(e) AS e, len(list_intersect(p, e)) AS b FROM s)
        SELECT source, round(CASE WHEN p = 0 AND e = 0 THEN 1 WHEN p > 0 THEN b / p ELSE 0 END, 6) AS citation_precision, round(CASE WHEN p = 0 AND e = 0 THEN 1 WHEN e > 0 THEN b / e ELSE 0 END, 6) AS citation_recall, round(CASE WHEN p = 0 AND e = 0 THEN 1 WHEN b > 0 THEN 2.0 * b / (p + e) ELSE 0 END, 6)::DOUBLE AS citation_f1 FROM n""",
    "eval_summary": """WITH r AS (SELECT document_type AS category, doc_id % 11 = 0 AS err, doc_id % 4 AS v, doc_id % 3 = 0 AS p, (doc_id % 7) / 7.0::DOUBLE AS f, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 9) / 9.0::DOUBLE END AS m, n_chars::DOUBLE AS l FROM documents WHERE document_type IS NOT NULL)
        SELECT category, round(avg(f) FILTER (NOT err), 6) AS citation_f1, round(avg(m) FILTER (NOT err), 6) AS mrr, round(avg(l) FILTER (NOT err), 6) AS latency_ms, round(avg(CASE v WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE) FILTER (NOT err), 6) AS accuracy,
        round(avg((v = 3)::INT) FILTER (NOT err), 6) AS hallucination_rate, round(avg(p::INT) FILTER (NOT err), 6) AS verification_pass_rate, sum(err::INT)::BIGINT AS error_count, count(*) AS total, grouping(category)::INT AS overall FROM r GROUP BY GROUPING SETS ((), (category))""",
    "baseline_compare": _COMPARE + " SELECT metric, scope, baseline::DOUBLE AS baseline, current::DOUBLE AS current, delta::DOUBLE AS delta, status FROM findings",
    "baseline_status": _COMPARE
    + """ SELECT f.metric, scope, format('{:.3f}', baseline::DOUBLE) AS baseline, format('{:.3f}', current::DOUBLE) AS current, format('{:+.3f}', delta::DOUBLE) AS delta, status,
        (SELECT max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) FROM findings x WHERE x.metric = f.metric)::INT AS severity FROM findings f WHERE scope = 'aggregate'""",
    "judge_parse": """SELECT doc_id, v AS verdict, r AS reasoning, CASE v WHEN 'CORRECT' THEN 1 WHEN 'PARTIAL' THEN 0.5 ELSE 0 END::DOUBLE AS score
        FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['CORRECT', 'PARTIAL', 'UNSUPPORTED', 'INCORRECT'][doc_id % 4 + 1] ELSE 'INCORRECT' END AS v, CASE WHEN doc_id % 3 = 0 THEN 'r' || doc_id ELSE '' END AS r FROM documents)""",
}
