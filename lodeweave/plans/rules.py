"""Queries of compliance: intent, filters, dates, supersession, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, compliance, fusion
from ..operators.bm25 import BM25Index
from ..session import cut, table
from .retrieval import STORED, bm25_sql, stored_chunks

#: Names of regulations that questions over these tables may hold.
NAMES = ["CARD HANDLING STANDARD", "CLOUD ASSURANCE FRAMEWORK", "DATA STEWARDSHIP REGULATION", "GDPR", "HEALTH RECORDS CODE", "LEDGER RESILIENCE ACT"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of the recorded provisions, five kinds by update number."""
    u = table(spark, sf_dir, "legal_metadata_updates").dropDuplicates(["update_id"])
    text = (
        F.when(F.col("update_id") % 5 == 0, F.concat(F.lit("Show "), F.coalesce("article", "section", F.lit("the annex"))))
        .when(F.col("update_id") % 5 == 1, F.concat(F.lit("What does "), F.coalesce("section", "article", F.lit("the annex")), F.lit(" say?")))
        .when(F.col("update_id") % 5 == 2, F.concat(F.lit("Duties under the "), F.coalesce("regulation", F.lit("act"))))
        .when(F.col("update_id") % 5 == 3, F.concat(F.lit("Rules in force in the "), F.coalesce("jurisdiction", F.lit("region"))))
        .otherwise(F.concat(F.lit("Compare clause "), F.coalesce("clause", F.lit("lists")), F.lit(" across versions")))
    )
    return u.select(F.col("update_id").alias("query_id"), text.alias("question"))


def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and filter of every question."""
    q = _questions(spark, sf_dir).withColumn("_i", compliance.classify(F.col("question"), NAMES))
    return q.select("query_id", F.col("_i.kind").alias("kind"), F.array_join(F.transform(F.map_entries("_i.filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("filters"))


def comparative_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question, and each document's text, compares."""
    q = _questions(spark, sf_dir).select(F.lit("question").alias("kind"), "query_id", compliance.is_comparative(F.col("question")).alias("comparative"))
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.lit("document"), "doc_id", compliance.is_comparative(F.col("text")))
    return q.union(d)


def legal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current chunks of one regulation and jurisdiction, as a filter with loose and exact fields finds them."""
    out = compliance.legal_filter(stored_chunks(spark, sf_dir), {"regulation": "data stewardship", "jurisdiction": "EU", "is_current": "true"})
    return out.select("chunk_id", "document_id", "chunk_index")


def as_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one kind of regulation the chunks of the latest date up to the end of each month."""
    held = stored_chunks(spark, sf_dir).filter("legal_metadata is not null and contains(lower(legal_metadata.regulation), 'act')")
    days = spark.sql("select explode(sequence(date'2015-01-31', date'2026-12-31', interval 1 month)) as day").select(F.last_day("day").alias("day"))
    return compliance.as_of_days(held, days, F.col("legal_metadata.effective_date")).select("day", "chunk_id", "document_id", "legal_metadata.effective_date")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = [F.col(f"legal_metadata.{f}").alias(f) for f in (*compliance.IDENTITY, "effective_date", "is_current", "superseded_by")]
    return stored_chunks(spark, sf_dir).filter("legal_metadata is not null").select("chunk_id", "document_id", *meta).filter("regulation is not null and (article is not null or section is not null)")


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk of each provision is current and what supersedes the others."""
    return compliance.supersede(_metadata(spark, sf_dir)).select("chunk_id", "new_is_current", "new_superseded_by")


def supersession_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit event for each chunk that stopped being current."""
    done = compliance.supersede(_metadata(spark, sf_dir))
    events = audit.supersession_events(done, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    return events.select("event_type", "status", "document_id", F.col("regulation_metadata")["superseded_by"].alias("superseded_by"))


def wildcard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that share a chunk's provision when its missing fields match anything."""
    rows = cut(_metadata(spark, sf_dir), "wildcard")
    keys = rows.filter("effective_date is not null").select(*compliance.IDENTITY).distinct().withColumn("key_id", F.md5(F.concat_ws("|", *[F.coalesce(f, F.lit("-")) for f in compliance.IDENTITY])))
    found = compliance.wildcard_matches(keys, rows.withColumnRenamed("chunk_id", "row_id"))
    return found.groupBy("key_id").agg(F.count("*").alias("matches"))


def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth question by its route: named chunks, or BM25 hits, all or among the named ones."""
    chunks = cut(stored_chunks(spark, sf_dir), "routed-chunks")
    q = cut(_questions(spark, sf_dir).filter("query_id % 20 = 0").withColumn("intent", compliance.classify(F.col("question"), NAMES)), "routed-questions")
    hits = BM25Index.build(chunks, "chunk_id", "text").search(q.filter("intent.kind <> 'structured'"), k=10, text_col="question")
    fused = fusion.weighted_rrf(hits.limit(0), hits)
    meta = chunks.withColumn("legal_metadata", F.col("legal_metadata").withField("article", F.regexp_extract("legal_metadata.article", r"(\d+[A-Za-z]?)", 1)).withField("section", F.regexp_extract("legal_metadata.section", r"([\d.]+)", 1)))
    return compliance.route(q, meta, fused)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured citations of the chunks that structured questions find, with scores by rank."""
    hits = routed_search(spark, sf_dir)
    chunks = table(spark, sf_dir, "chunks").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("document_id", "chunk_index", "text", "page", "legal_metadata"), F.struct("ingested_at", F.coalesce("text", F.lit("")))).alias("_c")).select("chunk_id", "_c.*")
    ranked = hits.select("query_id", F.col("id").alias("chunk_id"), F.when(F.col("kind") == "structured", F.col("rrf_score")).alias("rerank_score")).join(chunks, "chunk_id")
    titles = table(spark, sf_dir, "source_documents").groupBy("document_id").agg(F.min("source_path").alias("filename"))
    c = compliance.citations(ranked, titles)
    return c.select("query_id", "chunk_id", "document_id", "document_title", "confidence", "display", F.md5("chunk_text").alias("text_md5"), "regulation", "article", "clause", "effective_date", "page")


def audit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and regulations behind the citations of every question, as its event records them."""
    out = audit.answered(citations(spark, sf_dir))
    return out.select("query_id", F.array_join("retrieved_document_ids", ",").alias("documents"), F.array_join("cited_regulations", ",").alias("regulations"))


def citation_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every chunk would be cited."""
    c = stored_chunks(spark, sf_dir).withColumn("page", F.lit(None).cast("int"))
    return c.select("chunk_id", compliance.citation_display(F.coalesce("document_id", F.lit("unknown")), F.col("chunk_index"), F.col("page"), F.col("legal_metadata")).alias("display"))


QUERIES = {f.__name__: f for f in (route_classify, comparative_flag, legal_filter, as_of_date, supersession, supersession_events, wildcard_candidates, routed_search, citations, audit_fields, citation_display)}

_ELABORATE = r"(?i)\b(explain|what|why|how|summarize|does|say|mean)\b"
_QUESTIONS = """q AS (SELECT update_id AS query_id, CASE update_id % 5 WHEN 0 THEN 'Show ' || coalesce(article, section, 'the annex') WHEN 1 THEN 'What does ' || coalesce(section, article, 'the annex') || ' say?'
    WHEN 2 THEN 'Duties under the ' || coalesce(regulation, 'act') WHEN 3 THEN 'Rules in force in the ' || coalesce(jurisdiction, 'region') ELSE 'Compare clause ' || coalesce(clause, 'lists') || ' across versions' END AS t
    FROM (SELECT DISTINCT ON (update_id) * FROM legal_metadata_updates))"""
_COMPARE = "|".join(compliance.COMPARATIVE)
_META = f"""WITH {STORED}, m AS (SELECT chunk_id, document_id, legal_metadata.regulation AS regulation, legal_metadata.authority AS authority, legal_metadata.jurisdiction AS jurisdiction, legal_metadata.article AS article, legal_metadata.section AS section,
    legal_metadata.clause AS clause, legal_metadata.effective_date AS d, legal_metadata.is_current AS c, legal_metadata.superseded_by AS s FROM stored WHERE legal_metadata IS NOT NULL AND legal_metadata.regulation IS NOT NULL AND (legal_metadata.article IS NOT NULL OR legal_metadata.section IS NOT NULL))"""
_SUPER = (
    _META
    + """, i AS (SELECT regulation, authority, jurisdiction, article, section, clause, md5(concat_ws('|', coalesce(regulation, '-'), coalesce(authority, '-'), coalesce(jurisdiction, '-'), coalesce(article, '-'), coalesce(section, '-'), coalesce(clause, '-'))) AS key,
        (regulation IS NULL)::INT + (authority IS NULL)::INT + (jurisdiction IS NULL)::INT + (article IS NULL)::INT + (section IS NULL)::INT + (clause IS NULL)::INT AS missing FROM (SELECT DISTINCT regulation, authority, jurisdiction, article, section, clause FROM m WHERE d IS NOT NULL)),
    x AS (SELECT k.key, k.missing, r.key AS row FROM i k JOIN i r ON contains(lower(r.regulation), lower(k.regulation)) AND (k.authority IS NULL OR contains(lower(r.authority), lower(k.authority))) AND (k.jurisdiction IS NULL OR r.jurisdiction = k.jurisdiction)
        AND (k.article IS NULL OR r.article = k.article) AND (k.section IS NULL OR r.section = k.section) AND (k.clause IS NULL OR r.clause = k.clause)),
    n AS (SELECT m.*, i.key AS row FROM m LEFT JOIN i ON m.d IS NOT NULL AND i.regulation IS NOT DISTINCT FROM m.regulation AND i.authority IS NOT DISTINCT FROM m.authority AND i.jurisdiction IS NOT DISTINCT FROM m.jurisdiction AND i.article IS NOT DISTINCT FROM m.article AND i.section IS NOT DISTINCT FROM m.section AND i.clause IS NOT DISTINCT FROM m.clause),
    g AS (SELECT key, any_value(missing) AS missing, max(d) AS last, count(*) AS rows FROM x JOIN n USING (row) GROUP BY key HAVING count(*) >= 2),
    h AS (SELECT g.key, g.missing, min(n.document_id) AS doc FROM g JOIN x ON x.key = g.key JOIN n ON n.row = x.row AND n.d = g.last GROUP BY g.key, g.missing HAVING count(DISTINCT coalesce(n.document_id, '?')) = 1 AND min(n.document_id) IS NOT NULL),
    one AS (SELECT x.row, arg_min(h.doc, (h.missing, ORDERKEY)) AS doc FROM x JOIN h ON h.key = x.key GROUP BY x.row),
    done AS (SELECT n.*, CASE WHEN doc IS NOT NULL AND c IS DISTINCT FROM coalesce(document_id = doc, FALSE) THEN coalesce(document_id = doc, FALSE) ELSE c END AS new_is_current,
        CASE WHEN doc IS NOT NULL AND c IS DISTINCT FROM coalesce(document_id = doc, FALSE) THEN CASE WHEN document_id = doc THEN NULL ELSE doc END ELSE s END AS new_superseded_by FROM n LEFT JOIN one USING (row))"""
).replace("ORDERKEY", "h.key")
SQL = {
    "route_classify": rf"""WITH {_QUESTIONS}, r AS (SELECT query_id, t, nullif(regexp_extract(t, '(?i)\bclause\s+([\d.]+(?:\([a-z]\))?)', 1), '') AS c, nullif(regexp_extract(t, '(?i)\barticle\s+(\d+[A-Za-z]?)', 1), '') AS a, nullif(regexp_extract(t, '(?i)\bsection\s+([\d.]+)', 1), '') AS s,
        list_filter({NAMES}, lambda x: contains(upper(t), x))[1] AS g, list_filter(['EU', 'INDIA', 'UK', 'US'], lambda x: regexp_matches(upper(t), '\b' || x || '\b'))[1] AS j FROM q)
        SELECT query_id, CASE WHEN coalesce(c, a, s) IS NOT NULL THEN CASE WHEN regexp_matches(t, '{_ELABORATE}') THEN 'mixed' ELSE 'structured' END WHEN coalesce(g, j) IS NOT NULL THEN 'metadata' ELSE 'semantic' END AS kind,
        CASE WHEN c IS NOT NULL THEN 'clause=' || c WHEN a IS NOT NULL THEN 'article=' || a WHEN s IS NOT NULL THEN 'section=' || s WHEN g IS NOT NULL THEN 'regulation=' || g WHEN j IS NOT NULL THEN 'jurisdiction=' || j ELSE '' END AS filters FROM r""",
    "comparative_flag": rf"""WITH {_QUESTIONS} SELECT 'question' AS kind, query_id, regexp_matches(t, '(?i)\b({_COMPARE})\b') AS comparative FROM q UNION ALL SELECT 'document', doc_id, regexp_matches(text, '(?i)\b({_COMPARE})\b') FROM documents WHERE text IS NOT NULL""",
    "legal_filter": f"WITH {STORED} SELECT chunk_id, document_id, chunk_index FROM stored WHERE contains(lower(legal_metadata.regulation), 'data stewardship') AND legal_metadata.jurisdiction = 'EU' AND legal_metadata.is_current",
    "as_of_date": f"""WITH {STORED}, f AS (SELECT chunk_id, document_id, legal_metadata.effective_date AS effective_date FROM stored WHERE contains(lower(legal_metadata.regulation), 'act') AND legal_metadata.effective_date IS NOT NULL),
        days AS (SELECT last_day(range::DATE) AS day FROM range(DATE '2015-01-01', DATE '2027-01-01', INTERVAL 1 MONTH)), l AS (SELECT day, max(effective_date) AS effective_date FROM days JOIN f ON effective_date <= day GROUP BY day)
        SELECT day, chunk_id, document_id, effective_date FROM f JOIN l USING (effective_date)""",
    "supersession": _SUPER + " SELECT chunk_id, new_is_current, new_superseded_by FROM done",
    "supersession_events": _SUPER + " SELECT 'supersession' AS event_type, 'success' AS status, document_id, new_superseded_by AS superseded_by FROM done WHERE c AND NOT new_is_current",
    "wildcard_candidates": _META
    + """, k AS (SELECT DISTINCT regulation, authority, jurisdiction, article, section, clause FROM m WHERE d IS NOT NULL),
    x AS (SELECT k.*, md5(concat_ws('|', coalesce(regulation, '-'), coalesce(authority, '-'), coalesce(jurisdiction, '-'), coalesce(article, '-'), coalesce(section, '-'), coalesce(clause, '-'))) AS key_id FROM k)
    SELECT key_id, count(*) AS matches FROM x JOIN m ON contains(lower(m.regulation), lower(x.regulation)) AND (x.authority IS NULL OR contains(lower(m.authority), lower(x.authority))) AND (x.jurisdiction IS NULL OR m.jurisdiction = x.jurisdiction)
        AND (x.article IS NULL OR m.article = x.article) AND (x.section IS NULL OR m.section = x.section) AND (x.clause IS NULL OR m.clause = x.clause) GROUP BY key_id""",
    "citation_display": rf"""WITH {STORED}, p AS (SELECT chunk_id, coalesce(document_id, 'unknown') AS t, chunk_index AS i, legal_metadata AS m, nullif(legal_metadata.page, 0) AS pg, CASE WHEN contains(legal_metadata.clause, '.') THEN substr(legal_metadata.clause, instr(legal_metadata.clause, '.') + 1) END AS tail FROM stored)
        SELECT chunk_id, CASE WHEN m IS NULL OR (m.regulation IS NULL AND m.article IS NULL) THEN t || ', chunk ' || i ELSE
        concat_ws(' ', nullif(m.regulation, ''), CASE WHEN m.article <> '' THEN 'Art. ' || m.article || CASE WHEN tail IS NULL THEN '' WHEN instr(tail, '(') > 0 THEN '(' || substr(tail, 1, instr(tail, '(') - 1) || ')' || substr(tail, instr(tail, '(')) ELSE '(' || tail || ')' END
        WHEN m.clause <> '' THEN 'Clause ' || m.clause END) || coalesce(', p.' || pg, '') END AS display FROM p""",
}

_KINDS = SQL["route_classify"].split(" SELECT query_id, CASE WHEN coalesce(c, a, s)")[0]
_ROUTED = (
    _KINDS
    + rf""", i AS (SELECT query_id, t, CASE WHEN coalesce(c, a, s) IS NOT NULL THEN CASE WHEN regexp_matches(t, '{_ELABORATE}') THEN 'mixed' ELSE 'structured' END WHEN coalesce(g, j) IS NOT NULL THEN 'metadata' ELSE 'semantic' END AS kind,
        CASE WHEN c IS NOT NULL THEN 'clause' WHEN a IS NOT NULL THEN 'article' WHEN s IS NOT NULL THEN 'section' WHEN g IS NOT NULL THEN 'regulation' WHEN j IS NOT NULL THEN 'jurisdiction' END AS field, coalesce(c, a, s, g, j) AS value FROM r WHERE query_id % 20 = 0),
    {STORED}, """
    + bm25_sql("hits", "SELECT chunk_id AS id, text FROM stored", "SELECT query_id, t AS text FROM i WHERE kind <> 'structured'")
    + r""", named AS (SELECT query_id, chunk_id AS id, kind, document_id, chunk_index FROM i JOIN stored ON CASE field WHEN 'clause' THEN legal_metadata.clause = value WHEN 'article' THEN regexp_extract(legal_metadata.article, '(\d+[A-Za-z]?)', 1) = value
        WHEN 'section' THEN regexp_extract(legal_metadata.section, '([\d.]+)', 1) = value WHEN 'jurisdiction' THEN legal_metadata.jurisdiction = value WHEN 'regulation' THEN contains(lower(legal_metadata.regulation), lower(value)) END),
    rest AS (SELECT h.query_id, h.id, round(0.3 / (60 + rank), 9)::DOUBLE AS rrf_score, rank, kind FROM hits h JOIN i USING (query_id) WHERE kind = 'semantic' OR EXISTS (SELECT 1 FROM named n WHERE n.query_id = h.query_id AND n.id = h.id))
    SELECT query_id, id, 1.0::DOUBLE AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY document_id NULLS FIRST, chunk_index NULLS FIRST, id)::INT AS final_rank, kind FROM named WHERE kind = 'structured'
    UNION ALL SELECT query_id, id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT, kind FROM rest"""
).replace("\\\\", "\\")
SQL["routed_search"] = _ROUTED
SQL["citations"] = (
    _ROUTED.split(" SELECT query_id, id, 1.0::DOUBLE AS rrf_score")[0]
    + r""", hit AS (SELECT query_id, id, 1.0::DOUBLE AS score FROM named WHERE kind = 'structured' UNION ALL SELECT query_id, id, NULL FROM rest),
    c AS (SELECT chunk_id, document_id, chunk_index, text, page, legal_metadata AS m FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, coalesce(text, '') DESC) = 1),
    f AS (SELECT document_id, min(source_path) AS filename FROM source_documents GROUP BY document_id),
    j AS (SELECT hit.query_id, c.*, hit.score, coalesce(filename, c.document_id) AS t, coalesce(nullif(m.page, 0), nullif(c.page, 0)) AS pg, CASE WHEN contains(m.clause, '.') THEN substr(m.clause, instr(m.clause, '.') + 1) END AS tail FROM hit JOIN c ON c.chunk_id = hit.id LEFT JOIN f ON f.document_id = c.document_id)
    SELECT query_id, chunk_id, document_id, CASE WHEN m IS NOT NULL THEN m.document_title ELSE t END AS document_title, coalesce(score, 0)::DOUBLE AS confidence,
        CASE WHEN m IS NULL OR (m.regulation IS NULL AND m.article IS NULL) THEN t || coalesce(', p.' || nullif(page, 0), '') || ', chunk ' || chunk_index ELSE
        concat_ws(' ', nullif(m.regulation, ''), CASE WHEN m.article <> '' THEN 'Art. ' || m.article || CASE WHEN tail IS NULL THEN '' WHEN instr(tail, '(') > 0 THEN '(' || substr(tail, 1, instr(tail, '(') - 1) || ')' || substr(tail, instr(tail, '(')) ELSE '(' || tail || ')' END
        WHEN m.clause <> '' THEN 'Clause ' || m.clause END) || coalesce(', p.' || pg, '') END AS display, md5(text) AS text_md5, m.regulation AS regulation, m.article AS article, m.clause AS clause, m.effective_date AS effective_date, coalesce(nullif(m.page, 0), page) AS page FROM j"""
)
_CITED = SQL["citations"].replace("    SELECT query_id, chunk_id, document_id, CASE WHEN m IS NOT NULL", "    cites AS (SELECT query_id, chunk_id, document_id, CASE WHEN m IS NOT NULL").replace("AND c.legal", "AND c.legal")
SQL["audit_fields"] = _CITED.replace(" AS tail FROM hit JOIN c ON c.chunk_id = hit.id LEFT JOIN f ON f.document_id = c.document_id)", " AS tail FROM hit JOIN c ON c.chunk_id = hit.id LEFT JOIN f ON f.document_id = c.document_id),") + ") SELECT query_id, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS documents, coalesce(string_agg(DISTINCT nullif(regulation, ''), ',' ORDER BY nullif(regulation, '')), '') AS regulations FROM cites GROUP BY query_id"
