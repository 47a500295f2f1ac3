"""Queries of the store, the audit log and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, snapshot
from ..operators.chunking import chunk_recursive
from ..session import shared_dir, table
from ..streaming import ingest_stream, limited, sessions
from .documents import SQL as DOCUMENT_SQL
from .retrieval import STORED, stored_chunks


def doc_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and first time of indexing of every document."""
    return snapshot.document_summaries(table(spark, sf_dir, "chunks").filter("document_id is not null"), paths=table(spark, sf_dir, "source_documents"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and chunks by strategy."""
    c = table(spark, sf_dir, "chunks").filter("chunk_id is not null").select("strategy_version", "document_id", "chunk_id").distinct()
    return snapshot.totals(c.groupBy("strategy_version", "document_id").agg(F.count("*").alias("chunk_count")), ["strategy_version"])


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with the first chunk's preview and regulation."""
    c = stored_chunks(spark, sf_dir).filter("document_id is not null")
    s = c.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return snapshot.document_detail(c, s).select("document_id", "chunk_count", F.col("legal_metadata.regulation").alias("regulation"), F.md5("preview").alias("preview_md5"))


def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids that only the store or only the vectors have."""
    return snapshot.drift(table(spark, sf_dir, "chunks").filter("chunk_id is not null"), table(spark, sf_dir, "embedding_records").filter("chunk_id is not null"))


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed documents that have no chunks yet."""
    return snapshot.resume(table(spark, sf_dir, "source_documents").select("source_path", "document_id").distinct(), table(spark, sf_dir, "chunks").filter("document_id is not null"), "document_id")


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every listed file against hashes known so far (of markdown and text files, half of them outdated)."""
    s = table(spark, sf_dir, "source_documents").select("source_path", "document_id", "format").distinct()
    known = s.filter("format in ('markdown', 'text')").select("source_path", F.when(F.substring("document_id", 1, 1) < "8", F.lit("outdated")).otherwise(F.col("document_id")).alias("document_id"))
    return snapshot.change_state(s, known).select("source_path", "state")


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a month's errors, newest first."""
    e = audit.select(table(spark, sf_dir, "events"), {"event_type": "error"}, "2024-01-02 00:00:00", "2024-01-20 00:00:00", time="ts")
    return audit.page_with_total(e, 100, 50, time="ts").select("event_id", "ts", "user_id", "total")


def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, their mean duration, and how many users."""
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "error", "failure").otherwise("success")).withColumn("duration_ms", F.col("value"))
    return audit.counters(e)


def audit_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one week by day and type."""
    return audit.by_day(table(spark, sf_dir, "events"), "2024-01-08", "2024-01-14", "ts").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beyond the first of a user in a minute."""
    return audit.rate_limit(table(spark, sf_dir, "events"), 1).filter("not allowed").select("event_id", "user_id", "minute")


def _run(stream: DataFrame, path: str) -> None:
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and refusals of every finished minute, from a stream of events."""
    at = f"{shared_dir(spark)}/limits-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{at}/in")
    _run(limited(stream, 1), at)
    return spark.read.parquet(f"{at}/out").withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that ended, from a stream of events."""
    at = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").write.parquet(f"{at}/in")
    _run(sessions(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{at}/in")), at)
    return spark.read.parquet(f"{at}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that land in two files, and once more under other paths with every other content changed, chunked and
    indexed batch by batch; the store's final chunks."""
    at = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "source_documents").filter("content is not null").select("document_id", "source_path", "content", "format").distinct()
    docs.coalesce(1).write.parquet(f"{at}/landing")
    store = snapshot.ChunkStore(spark, f"{at}/store")
    ingest_stream(spark, f"{at}/landing", store, f"{at}/checkpoint", chunk_recursive).awaitTermination()
    changed = F.when(F.substring("document_id", 1, 1) < "8", F.concat(F.lit("Changed.\n\n"), "content")).otherwise(F.col("content"))
    docs.withColumn("content", changed).coalesce(1).write.mode("append").parquet(f"{at}/landing")
    ingest_stream(spark, f"{at}/landing", store, f"{at}/checkpoint", chunk_recursive).awaitTermination()
    return store.chunks().select("document_id", "chunk_index", "heading", "text")


def store_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written, a document deleted, metadata changed: what the last version holds, by document."""
    store = snapshot.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    c = stored_chunks(spark, sf_dir).filter("document_id is not null")
    store.upsert(c)
    gone = c.agg(F.min("document_id")).first()[0]
    if gone is not None:
        store.delete_document(gone)
    store.update_metadata(c.filter("legal_metadata.is_current").select("chunk_id", F.lit(False).alias("is_current"), F.lit("next").alias("superseded_by")))
    return store.chunks().groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.coalesce(F.col("legal_metadata.is_current"), F.lit(False)).cast("int")).alias("current"), F.sum((F.col("legal_metadata.superseded_by") == "next").cast("int")).alias("superseded"))


QUERIES = {f.__name__: f for f in (doc_summaries, corpus_totals, document_detail, index_drift, resume_anti, change_detect, audit_query, audit_counters, audit_by_day, rate_limit, rate_limit_stream, session_stream, stream_ingest, store_round)}
SQL = {
    "doc_summaries": "SELECT c.*, source_path FROM (SELECT document_id, count(*) AS chunk_count, min(ingested_at) AS indexed_at FROM chunks WHERE document_id IS NOT NULL GROUP BY document_id) c LEFT JOIN (SELECT document_id, min(source_path) AS source_path FROM source_documents GROUP BY document_id) USING (document_id)",
    "corpus_totals": "SELECT strategy_version, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM (SELECT DISTINCT strategy_version, document_id, chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY strategy_version",
    "index_drift": """SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) a
        FULL JOIN (SELECT DISTINCT chunk_id FROM embedding_records WHERE chunk_id IS NOT NULL) b ON a.chunk_id = b.chunk_id WHERE a.chunk_id IS NULL OR b.chunk_id IS NULL""",
    "resume_anti": "SELECT DISTINCT document_id, source_path FROM source_documents WHERE document_id NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)",
    "change_detect": "SELECT DISTINCT source_path, CASE WHEN format NOT IN ('markdown', 'text') THEN 'new' WHEN document_id[1] < '8' THEN 'changed' ELSE 'unchanged' END AS state FROM source_documents",
    "audit_query": "SELECT event_id, ts, user_id, count(*) OVER () AS total FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100",
    "audit_counters": "SELECT event_type, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, count(*) AS n, round(avg(value), 2) AS mean_ms FROM events GROUP BY event_type",
    "audit_by_day": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY ALL",
    "rate_limit": "SELECT event_id, user_id, date_trunc('minute', ts) AS minute FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) > 1",
}
#: A window is finished when its end is no later than the greatest time less the allowed lateness.
SQL["rate_limit_stream"] = """SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests, greatest(count(*) - 1, 0)::BIGINT AS refused FROM events
    GROUP BY user_id, date_trunc('minute', ts) HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE"""
SQL["session_stream"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS "start", (max(ts) + INTERVAL 30 MINUTE) AS "end", count(*) AS events FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
SQL["document_detail"] = f"""WITH {STORED}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n, count(*) OVER (PARTITION BY document_id) AS chunk_count FROM stored WHERE document_id IS NOT NULL)
    SELECT document_id, chunk_count, legal_metadata.regulation AS regulation, md5(substr(text, 1, 1000)) AS preview_md5 FROM f WHERE n = 1"""
#: The sections of contents as they are at the end, by the SQL of the chunker.
_LAST = "WITH d AS (SELECT DISTINCT sha256(c) AS document_id, c AS content FROM (SELECT CASE WHEN document_id[1] < '8' THEN 'Changed.' || chr(10) || chr(10) || content ELSE content END AS c FROM source_documents WHERE content IS NOT NULL)),"
SQL["stream_ingest"] = _LAST + DOCUMENT_SQL["chunk_recursive"].split("WHERE content IS NOT NULL),", 1)[1]
SQL["store_round"] = f"""WITH {STORED}, s AS (SELECT * FROM stored WHERE document_id IS NOT NULL), g AS (SELECT min(document_id) AS gone FROM s)
    SELECT document_id, count(*) AS chunks, 0::BIGINT AS current, sum(CASE WHEN legal_metadata.superseded_by = 'next' OR legal_metadata.is_current THEN 1 WHEN legal_metadata.superseded_by IS NOT NULL THEN 0 END)::BIGINT AS superseded FROM s, g WHERE document_id <> gone GROUP BY document_id"""
