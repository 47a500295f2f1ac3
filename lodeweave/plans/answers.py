"""Queries of answers: claims, verdicts, confidence, status, quotes, parsing, prompts. Contexts are the BM25 hits of every
twentieth title; claims are made from them so that every verdict occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collapse, inline_citations
from ..operators import answer, evaluation
from ..providers import deterministic_answer
from ..session import cut, table
from .retrieval import BM25, bm25_topk


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """BM25 hits, and what of their texts fits the context."""
    found = cut(bm25_topk(spark, sf_dir), "hits")
    hits = found.join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source"), "doc_id")
    kept = answer.budget(hits.select("query_id", F.col("doc_id").alias("chunk_id"), F.col("rank").alias("final_rank"), "text", F.col("source").alias("document_id")))
    return found, cut(kept.select("query_id", "chunk_id", "document_id", "label", "position", "final_rank", "text"), "context")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[1]


def _claims(context: DataFrame) -> DataFrame:
    """Nine claims per question: quotes from anywhere in its first text, true, damaged, from another text, or across two."""
    flat = collapse(F.col("text"))
    texts = context.groupBy("query_id").agg(F.max(F.when(F.col("position") == 1, flat)).alias("_a"), F.coalesce(F.max(F.when(F.col("position") == 2, flat)), F.lit("")).alias("_b"))
    at = (F.col("query_id") * 7) % F.greatest(F.length("_a") - 40, F.lit(1)) + 1
    first = texts.withColumn("_q", F.substring(F.col("_a"), at.cast("int"), F.lit(40)))
    near, half = F.concat(F.substring("_q", 1, 35), F.lit("z" * 5)), F.concat(F.substring("_q", 1, 20), F.lit("z" * 20))
    across = F.concat(F.substring("_a", -15, 15), F.lit(" "), F.substring("_b", 1, 25))
    kinds = [(["d1"], F.col("_q")), (["d2"], F.col("_q")), (["d1", "d99"], F.col("_q")), (["d1"], F.concat(F.col("_q"), F.lit(" [d1]"))), (["d1"], near), (["d1"], half), ([], F.col("_q")), (["d1"], across), (["d2"], near)]
    made = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*map(F.lit, ids)).cast("array<string>").alias("i"), q.alias("q")) for n, (ids, q) in enumerate(kinds, 1)])
    return first.select("query_id", F.explode(made).alias("_c")).select("query_id", F.col("_c.n").alias("claim_no"), F.col("_c.i").alias("citation_ids"), F.col("_c.q").alias("supporting_quote"))


def claim_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every claim, by exact containment."""
    context = _context(spark, sf_dir)
    return answer.verify_claims(_claims(context), context, answer.contained)


def claim_verify_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every claim, by the longest common run."""
    context = _context(spark, sf_dir)
    return answer.verify_claims(_claims(context), context)


def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts counted per answer."""
    return answer.verification_report(claim_verify_fuzzy(spark, sf_dir))


def claim_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every claim's quote stands in the text of its first label."""
    context = _context(spark, sf_dir)
    claims = _claims(context)
    return answer.claim_diagnostics(claims, answer.verify_claims(claims, context), context.withColumn("text", collapse(F.col("text"))))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of every answer and its band; the score of the first text is taken as a logit."""
    found, context = _found(spark, sf_dir)
    claims = _claims(context)
    results = answer.verify_claims(claims, context)
    ranked = found.select("query_id", F.col("rank").alias("final_rank"), F.when(F.col("query_id") % 40 == 0, F.round(F.col("score") - 5, 6)).alias("rerank_score"))
    queries = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"))
    out = answer.confidence(queries, ranked, claims, results, context)
    return out.withColumn("band", answer.confidence_band(F.col("retrieval"), F.col("overall")))


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every question: its citations against its own source, retrieval metrics of its own document, claims,
    and a verdict by its coverage; questions whose text is blank fail."""
    found, context = _found(spark, sf_dir)
    claims = _claims(context)
    results = cut(answer.verify_claims(claims, context), "results")
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0 and title is not null")
    q = d.select(F.col("doc_id").alias("query_id"), F.col("document_type").alias("category"), F.array_compact(F.array("source")).alias("citation_doc_ids"), F.coalesce(F.trim("text"), F.lit("")).alias("_t"))
    metrics = evaluation.retrieval_metrics(q, found, q.select("query_id", F.col("query_id").alias("doc_id")), "doc_id")
    good = claims.join(results.filter("passed"), ["query_id", "claim_no"], "left_semi")
    cited = answer.cited_documents(good, context, context.filter("document_id is not null"))
    cover = answer.confidence(q, found.select("query_id", F.col("rank").alias("final_rank"), F.lit(None).cast("double").alias("rerank_score")), claims, results, context).select("query_id", "coverage")
    answers = q.join(cited, "query_id", "left").join(cover, "query_id").select("query_id", F.lit("See [d1].").alias("answer"), F.col("document_ids").alias("citations"), "coverage", F.length("_t").cast("double").alias("latency_ms"), F.when(F.col("_t") == "", "blank").alias("error"))
    verdicts = cover.select("query_id", F.when(F.col("coverage") >= 0.5, "CORRECT").when(F.col("coverage") > 0.2, "PARTIAL").otherwise("UNSUPPORTED").alias("verdict"), F.lit("").alias("reasoning"))
    out = evaluation.question_records(q, answers, metrics, answer.verification_pass(q, results), verdicts)
    return out.select("query_id", "category", "status", "error_type", "error_message", F.array_join("citations", ",").alias("citations"), *evaluation.OBJECTIVE, "recall_1", "recall_3", "mrr", "verification_pass", "verdict", "latency_ms")


def inline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels marked in an answer's text against those of its claims, and the answer's status."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    text = F.concat(F.lit("As [d1] says, see [d"), F.col("doc_id") % 12 + 1, F.lit("] and [d2]."))
    made = d.select("doc_id", text.alias("answer"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("d1"), F.lit("d2"))).otherwise(F.array(F.lit("d1"), F.lit("d2"), F.concat(F.lit("d"), F.col("doc_id") % 12 + 1))).alias("ids"))
    seen = made.withColumn("_d", answer.drift(F.col("answer"), F.col("ids")))
    return seen.select("doc_id", F.array_join("_d.inline_ids", ",").alias("inline_ids"), F.col("_d.ok").alias("ok"), answer.citation_status((F.col("doc_id") % 5 == 0).cast("int"), F.col("_d.ok")).alias("citation_status"))


def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources behind the labels of each answer's claims."""
    context = _context(spark, sf_dir)
    out = answer.cited_documents(_claims(context), context, context.filter("document_id is not null"))
    return out.withColumn("document_ids", F.array_join("document_ids", ","))


def quote_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of the first text that is most like the question's title."""
    context = _context(spark, sf_dir)
    claims = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("claim_no"), F.col("title").alias("text"), F.array(F.lit("d1"), F.lit("d2")).alias("citation_ids"))
    return answer.extract_quotes(claims, context)


def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every question's context and prompt."""
    context = answer.context_text(_context(spark, sf_dir))
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    return context.join(q, "query_id").select("query_id", F.length("context").alias("context_chars"), (F.length(answer.prompt(F.col("question"), F.col("context"))) - F.length("context")).alias("frame_chars"), F.md5("context").alias("context_md5"))


def draft_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated JSON of four kinds of damage, made of every whole text, parsed."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    said = F.concat(F.lit("the "), F.lit('"'), F.regexp_replace("text", r'["\\\p{Cntrl}]', " "), F.lit('"'), F.lit(" trap"))
    whole = F.concat(F.lit('{"answer": "'), said, F.lit('", "claims": [{"text": "c", "citation_ids": ["d1"]}]}'))
    raw = F.when(F.col("doc_id") % 4 == 0, whole).when(F.col("doc_id") % 4 == 1, F.concat(whole, F.lit(" and so on"))).when(F.col("doc_id") % 4 == 2, F.lit('{"answer": "cut off", "claims": [{"te')).otherwise(F.concat(F.lit("plain "), "text"))
    return d.select("doc_id", answer.parsed_draft(raw).alias("_p")).select("doc_id", F.col("_p.answer").alias("answer"), F.size("_p.claims").alias("claims"), F.col("_p.error").isNotNull().alias("failed"))


def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, prompt, generation by the deterministic model, parsing, quotes, verdicts, confidence and status of every question."""
    context = _context(spark, sf_dir)
    q = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    prompts = q.join(answer.context_text(context), "query_id", "left").withColumn("raw", deterministic_answer(answer.prompt(F.col("question"), F.coalesce("context", F.lit("")))))
    drafts = cut(prompts.withColumn("_d", answer.parsed_draft("raw")).select("query_id", "question", "_d.*"), "drafts")
    claims = drafts.select("query_id", F.posexplode("claims").alias("claim_no", "_c")).select("query_id", "claim_no", "_c.text", "_c.citation_ids")
    quoted = cut(answer.extract_quotes(claims, context), "quoted")
    results = cut(answer.verify_claims(quoted, context), "results")
    score = answer.confidence(drafts, context.select("query_id", "final_rank", F.lit(None).cast("double").alias("rerank_score")), quoted, results, context)
    ids = quoted.groupBy("query_id").agg(F.flatten(F.collect_list("citation_ids")).alias("_ids"))
    report = answer.verification_report(results)
    out = drafts.join(score, "query_id").join(ids, "query_id", "left").join(report, "query_id", "left")
    ok = F.size(F.array_except(inline_citations(F.col("answer")), F.coalesce("_ids", F.array().cast("array<string>")))) == 0
    return out.select("query_id", "answer", "retrieval", "citations", "coverage", "overall", answer.citation_status(F.coalesce("failed_claims", F.lit(0)), ok).alias("citation_status"))


QUERIES = {f.__name__: f for f in (claim_verify, claim_verify_fuzzy, verification_report, claim_diagnostics, confidence, question_records, inline_drift, cited_documents, quote_extract, prompt_sizes, draft_parse, answer_pipeline)}

_SPACE = r"trim(regexp_replace({}, '[\s\p{{Z}}\x{{85}}\x1c-\x1f]+', ' ', 'g'))"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x1c-\x1f]+|[\s\p{{Z}}\x{{85}}\x1c-\x1f]+$', '', 'g')"
_CONTEXT = (
    BM25
    + f""", used AS (SELECT query_id, id AS chunk_id, source, rank, 'd' || rank AS label, coalesce(text, '') AS text, {_SPACE.format("coalesce(text, '')")} AS flat, sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id ORDER BY rank) AS u FROM hits JOIN documents ON doc_id = id),
    context AS (SELECT * FROM used WHERE rank = 1 OR u <= 8000)"""
)
_CLAIMS = (
    _CONTEXT
    + f""", one AS (SELECT query_id, max(flat) FILTER (rank = 1) AS a, coalesce(max(flat) FILTER (rank = 2), '') AS b FROM context GROUP BY query_id),
    two AS (SELECT *, substr(a, ((query_id * 7) % greatest(length(a) - 40, 1) + 1)::BIGINT, 40) AS s FROM one),
    claims AS (SELECT query_id, 1 AS claim_no, ['d1'] AS ids, s AS quote FROM two UNION ALL SELECT query_id, 2, ['d2'], s FROM two UNION ALL SELECT query_id, 3, ['d1', 'd99'], s FROM two
        UNION ALL SELECT query_id, 4, ['d1'], s || ' [d1]' FROM two UNION ALL SELECT query_id, 5, ['d1'], substr(s, 1, 35) || repeat('z', 5) FROM two UNION ALL SELECT query_id, 6, ['d1'], substr(s, 1, 20) || repeat('z', 20) FROM two
        UNION ALL SELECT query_id, 7, [], s FROM two UNION ALL SELECT query_id, 8, ['d1'], right(a, 15) || ' ' || substr(b, 1, 25) FROM two UNION ALL SELECT query_id, 9, ['d2'], substr(s, 1, 35) || repeat('z', 5) FROM two),
    every AS (SELECT query_id, list(label) AS labels, {_SPACE.format("string_agg(text, ' ' ORDER BY rank)")} AS whole FROM context GROUP BY query_id),
    base AS (SELECT c.*, labels, whole, {_SPACE.format("quote")} AS fq, len(list_filter(ids, lambda x: NOT list_contains(labels, x))) = 0 AS valid FROM claims c JOIN every USING (query_id)),
    best AS (SELECT b.query_id, claim_no, max(CASE WHEN list_contains(ids, label) THEN hit END) AS own, max(CASE WHEN NOT list_contains(ids, label) THEN hit END) AS other
        FROM (SELECT b.query_id, claim_no, ids, label, SCORE(fq, flat) AS hit FROM base b JOIN context x ON x.query_id = b.query_id) b GROUP BY ALL),
    results AS (SELECT query_id, claim_no, ids, quote, valid AS doc_ids_valid, CASE WHEN valid AND NOT mark THEN own ELSE 0 END::DOUBLE AS quote_match_score, valid AND NOT mark AND own >= 0.8 AS passed,
        CASE WHEN NOT valid THEN 'hallucinated_citation_id' WHEN mark THEN 'quote_contains_citation_marker' WHEN own >= 0.8 THEN NULL WHEN other >= 0.8 AND other > own THEN 'citation_reattribution_candidate'
            WHEN SCORE(fq, whole) >= 0.8 THEN 'quote_spans_multiple_chunks' ELSE 'quote_not_found' END AS failure_reason
        FROM (SELECT b.*, coalesce(own, 0) AS own, coalesce(other, 0) AS other, regexp_matches(quote, '\\[d\\d+\\]') AS mark FROM base b JOIN best USING (query_id, claim_no)))"""
)


def _scored(sql: str, fuzzy: bool) -> str:
    """SCORE(quote, text): 1 and 0 for contained or not, or the longest common run's share of the quote."""
    for t in ("flat", "whole"):
        run = f"list_max(list_transform(range(1, length(fq) + 1), lambda i: list_max(list_filter(range(0, length(fq) - i + 2), lambda n: contains({t}, substr(fq, i, n)))))) / length(fq)" if fuzzy else "0"
        sql = sql.replace(f"SCORE(fq, {t})", f"CASE WHEN fq = '' THEN 0.0 WHEN contains({t}, fq) THEN 1.0 ELSE round({run}, 6) END")
    return sql


_CLAIMS, _EXACT = _scored(_CLAIMS, True), _scored(_CLAIMS, False)
SQL = {
    "claim_verify": _EXACT + " SELECT query_id, claim_no, doc_ids_valid, quote_match_score, passed, failure_reason FROM results",
    "claim_diagnostics": _CLAIMS
    + """ SELECT r.query_id, claim_no, ids[1] AS citation_id, chunk_id, length(quote)::INT AS quote_length, coalesce(instr(flat, quote), 0) > 0 AND quote <> '' AS quote_found, (CASE WHEN quote = '' THEN 0 ELSE coalesce(instr(flat, quote), 0) END - 1)::INT AS quote_start,
        CASE WHEN quote <> '' AND coalesce(instr(flat, quote), 0) > 0 THEN instr(flat, quote) - 1 + length(quote) ELSE -1 END::INT AS quote_end, coalesce(failure_reason = 'quote_spans_multiple_chunks', FALSE) AS crossed_boundary, failure_reason
        FROM results r LEFT JOIN context c ON c.query_id = r.query_id AND c.label = ids[1]""",
    "claim_verify_fuzzy": _CLAIMS + " SELECT query_id, claim_no, doc_ids_valid, quote_match_score, passed, failure_reason FROM results",
    "verification_report": _CLAIMS + " SELECT query_id, count(*) AS total_claims, sum(passed::INT)::BIGINT AS verified_claims, (count(*) - sum(passed::INT))::BIGINT AS failed_claims, sum((NOT doc_ids_valid)::INT)::BIGINT AS hallucinated, sum((failure_reason IS NOT NULL AND failure_reason <> 'hallucinated_citation_id')::INT)::BIGINT AS missing_quotes FROM results GROUP BY query_id",
    "confidence": _CLAIMS
    + """, r AS (SELECT query_id, round(CASE WHEN query_id % 40 = 0 THEN 1 / (1 + exp(-round(score - 5, 6))) ELSE 1.0 / rank END, 6) AS v FROM hits WHERE rank = 1),
    c AS (SELECT query_id, round(avg(passed::INT), 6) AS v FROM results GROUP BY query_id),
    o AS (SELECT query_id, count(DISTINCT x.label) AS n FROM (SELECT query_id, unnest(ids) AS label FROM results WHERE doc_ids_valid) x JOIN context USING (query_id, label) GROUP BY query_id),
    m AS (SELECT query_id, count(*) AS n FROM context GROUP BY query_id),
    s AS (SELECT doc_id AS query_id, coalesce(r.v, 0)::DOUBLE AS retrieval, coalesce(c.v, 1)::DOUBLE AS citations, round(coalesce(coalesce(o.n, 0) / m.n, 0), 6)::DOUBLE AS coverage
        FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0) LEFT JOIN r ON r.query_id = doc_id LEFT JOIN c ON c.query_id = doc_id LEFT JOIN o ON o.query_id = doc_id LEFT JOIN m ON m.query_id = doc_id),
    t AS (SELECT *, round(0.4 * retrieval + 0.4 * citations + 0.2 * coverage, 6) AS overall FROM s)
    SELECT *, CASE WHEN retrieval < 0.35 THEN 'no evidence' WHEN overall > 0.8 THEN 'High' WHEN overall > 0.6 THEN 'Medium' ELSE 'Low' END AS band FROM t""",
    "draft_parse": r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'the "' || regexp_replace(text, '["\\\x00-\x1f\x7f]', ' ', 'g') || '" trap' WHEN 1 THEN 'the ' WHEN 2 THEN 'cut off' ELSE 'plain ' || text END AS answer,
        CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS claims, doc_id % 4 <> 0 AS failed FROM documents WHERE text IS NOT NULL""",
    "inline_drift": """WITH a AS (SELECT doc_id, 'd' || (doc_id % 12 + 1) AS x FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, x, list_distinct(['d1', 'd2', x]) AS f, CASE WHEN doc_id % 3 = 0 THEN ['d1', 'd2'] ELSE ['d1', 'd2', x] END AS ids FROM a),
        o AS (SELECT *, len(list_filter(f, lambda y: NOT list_contains(ids, y))) = 0 AS ok FROM l)
        SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(f, lambda y: lpad(y[2:], 4, '0'))), lambda y: 'd' || ltrim(y, '0')), ',') AS inline_ids, ok,
        CASE WHEN doc_id % 5 = 0 THEN 'verification_failed' WHEN NOT ok THEN 'inline_drift' ELSE 'ok' END AS citation_status FROM o""",
    "cited_documents": _CLAIMS + " SELECT query_id, string_agg(DISTINCT source, ',' ORDER BY source) AS document_ids, count(DISTINCT source) AS documents_used FROM (SELECT query_id, unnest(ids) AS label FROM claims) JOIN context USING (query_id, label) WHERE source IS NOT NULL GROUP BY query_id",
    "prompt_sizes": _CONTEXT
    + f""", t AS (SELECT query_id, string_agg('[' || label || ']' || chr(10) || {_STRIP.format("text")}, chr(10) || chr(10) ORDER BY rank) AS c FROM context GROUP BY query_id)
    SELECT query_id, length(c)::INT AS context_chars, (length(title) + {len(answer.PROMPTS["v2"].replace("{context}", "").replace("{question}", ""))})::INT AS frame_chars, md5(c) AS context_md5 FROM t JOIN documents ON doc_id = query_id""",
}
_SCORES = SQL["confidence"].split("t AS (SELECT *, round(0.4")[0].rstrip().rstrip(",")
SQL["question_records"] = (
    _SCORES
    + r""", w AS (SELECT doc_id AS query_id, document_type AS category, CASE WHEN source IS NULL THEN [] ELSE [source] END AS expected, trim(coalesce(text, '')) AS t FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
    cites AS (SELECT x.query_id, list(DISTINCT source ORDER BY source) AS docs FROM (SELECT query_id, unnest(ids) AS label FROM results WHERE passed) x JOIN context USING (query_id, label) WHERE source IS NOT NULL GROUP BY x.query_id),
    own AS (SELECT query_id, min(rank) AS r FROM hits WHERE id = query_id GROUP BY query_id), pass AS (SELECT query_id, bool_and(passed) AS p FROM results GROUP BY query_id),
    y AS (SELECT w.*, coalesce(docs, []) AS docs, coverage, r, coalesce(p, FALSE) AS p, t <> '' AS good, len(list_intersect(coalesce(docs, []), expected)) AS b FROM w JOIN s USING (query_id) LEFT JOIN cites USING (query_id) LEFT JOIN own USING (query_id) LEFT JOIN pass USING (query_id)),
    z AS (SELECT *, CASE WHEN len(docs) = 0 AND len(expected) = 0 THEN 1 WHEN len(docs) > 0 THEN b / len(docs) ELSE 0 END AS pr, CASE WHEN len(docs) = 0 AND len(expected) = 0 THEN 1 WHEN len(expected) > 0 THEN b / len(expected) ELSE 0 END AS re FROM y)
    SELECT query_id, category, CASE WHEN good THEN 'success' ELSE 'error' END AS status, CASE WHEN NOT good THEN 'pipeline_error' END AS error_type, CASE WHEN NOT good THEN 'blank' END AS error_message,
        CASE WHEN good THEN array_to_string(docs, ',') ELSE '' END AS citations, CASE WHEN good THEN round(pr, 6) END::DOUBLE AS citation_precision, CASE WHEN good THEN round(re, 6) END::DOUBLE AS citation_recall, CASE WHEN good THEN round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) END::DOUBLE AS citation_f1,
        CASE WHEN good THEN coverage END AS coverage, CASE WHEN good THEN CASE WHEN r = 1 THEN 1 ELSE 0 END END::DOUBLE AS recall_1, CASE WHEN good THEN CASE WHEN r <= 3 THEN 1 ELSE 0 END END::DOUBLE AS recall_3, CASE WHEN good THEN round(coalesce(1 / r, 0), 6) END::DOUBLE AS mrr,
        CASE WHEN good THEN p END AS verification_pass, CASE WHEN good THEN CASE WHEN coverage >= 0.5 THEN 'CORRECT' WHEN coverage > 0.2 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END END AS verdict, CASE WHEN good THEN length(t) END::DOUBLE AS latency_ms FROM z"""
)
