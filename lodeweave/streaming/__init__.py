"""Structured Streaming: documents as they land, limits per minute, and the audit log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_recursive
from ..operators.snapshot import ChunkStore, change_state
from ..session import cut

DOCUMENTS = "document_id string, source_path string, content string, format string"


def ingest_batch(store: ChunkStore, batch: DataFrame, chunker=chunk_recursive) -> None:
    """One micro-batch (source_path, content, and landed_at if there is one): of each path the content that landed last.

    The store keeps which document a path has. A document that several paths have is kept once, and goes when the last of
    them has another content; unchanged paths change nothing. Rows without content are passed over; of rows of one path and
    time the greatest content counts. A row that landed before what its path has already is late and passed over too.
    """
    time = F.col("landed_at") if "landed_at" in batch.columns else F.lit(None).cast("timestamp")
    rows = batch.filter("content is not null").select("source_path", time.alias("landed_at"), "content")
    last = rows.groupBy("source_path").agg(F.max_by(F.struct("content", "landed_at"), F.struct("landed_at", "content")).alias("_l"))
    docs = cut(last.select("source_path", F.sha2("_l.content", 256).alias("document_id"), "_l.content", "_l.landed_at"), "landed")
    known = store.paths()
    late = known.select("source_path", F.col("landed_at").alias("_at"))
    docs = docs.join(late, "source_path", "left").filter("_at is null or landed_at is null or landed_at >= _at").drop("_at")
    moved = change_state(docs, known).filter("state <> 'unchanged'").drop("state")
    paths = cut(known.join(moved.select("source_path"), "source_path", "left_anti").unionByName(moved.select("source_path", "document_id", "landed_at")), "paths")
    gone = known.join(paths.select("document_id"), "document_id", "left_anti").select("document_id")
    new = moved.join(known.select("document_id").distinct(), "document_id", "left_anti").dropDuplicates(["document_id"])
    store.replace(chunker(new).withColumn("ingested_at", F.current_timestamp()), gone, paths)


def ingest_stream(spark: SparkSession, landing: str, store: ChunkStore, checkpoint: str, chunker=chunk_recursive, schema: str = DOCUMENTS):
    """Everything that has landed (Parquet), batch after batch, each once; returns the started query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing).withColumn("landed_at", F.col("_metadata.file_modification_time"))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest_batch(store, batch, chunker)).start()


def limited(events: DataFrame, limit: int, key: str = "user_id", time: str = "ts", late: str = "2 minutes") -> DataFrame:
    """(key, minute, requests, refused) of finished minutes of a stream; events later than ``late`` are left out."""
    timed = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", "1 minute").alias("_w"), F.col(key)).agg(F.count("*").alias("requests"))
    refused = F.greatest(F.col("requests") - limit, F.lit(0)) if limit > 0 else F.lit(0)
    return counts.select(key, F.col("_w.start").alias("minute"), "requests", refused.cast("bigint").alias("refused"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, events) of a key's sessions in a stream."""
    timed = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap).alias("_w"), F.col(key)).agg(F.count("*").alias("events")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")
