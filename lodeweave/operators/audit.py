"""Audit log, rate limits, counters and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import norm

#: The fields of an event.
SCHEMA = """event_id string, event_type string, timestamp timestamp, request_id string, key_id string, role string, endpoint string,
action string, status string, duration_ms double, error string, document_id string, regulation_metadata map<string,string>,
query_text string, metadata_filters map<string,string>, retrieval_mode string, retrieved_document_ids array<string>,
cited_regulations array<string>, confidence_score double, retrieval_stats map<string,string>"""


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def select(events: DataFrame, equal: dict[str, object] | None = None, start=None, end=None, time: str = "timestamp") -> DataFrame:
    """Events with the given values; start and end included. A value of None is no condition."""
    out = events
    for name, value in (equal or {}).items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if start is not None:
        out = out.filter(F.col(time) >= F.lit(start).cast(out.schema[time].dataType))
    if end is not None:
        out = out.filter(F.col(time) <= F.lit(end).cast(out.schema[time].dataType))
    return out


def page(events: DataFrame, offset: int = 0, limit: int = 50, descending: bool = True, time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """A page of events by time, then id."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("a page has 1 to 500 rows")
    return events.orderBy(F.desc(time) if descending else F.asc(time), tie).offset(offset).limit(limit)


def page_with_total(events: DataFrame, offset: int = 0, limit: int = 50, descending: bool = True, time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """A page, with the number of all events that it is a page of in every row."""
    total = events.agg(F.count("*").alias("total"))  # one row
    return page(events, offset, limit, descending, time, tie).crossJoin(F.broadcast(total)).orderBy(F.desc(time) if descending else F.asc(time), tie)


def answered(citations: DataFrame) -> DataFrame:
    """(query_id, retrieved_document_ids, cited_regulations) of structured citations, distinct and sorted: what the event of
    a query records."""
    regulation = F.when(F.col("regulation") != "", F.col("regulation"))
    return citations.groupBy("query_id").agg(F.sort_array(F.collect_set("document_id")).alias("retrieved_document_ids"), F.sort_array(F.collect_set(regulation)).alias("cited_regulations"))


def by_day(events: DataFrame, first: str, last: str, time: str = "timestamp") -> DataFrame:
    return events.filter(F.to_date(time).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def export_csv(events: DataFrame, path: str) -> None:
    flat = events.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in events.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def supersession_events(superseded: DataFrame, now: Column) -> DataFrame:
    """An event for each row that supersession turned from current to not."""
    off = superseded.filter("is_current and not new_is_current")
    meta = F.map_from_arrays(F.array(*[F.lit(x) for x in ("regulation", "authority", "jurisdiction", "article", "section", "clause", "superseded_by")]), F.array("regulation", "authority", "jurisdiction", "article", "section", "clause", "new_superseded_by"))
    key = F.sha2(F.concat_ws("|", "document_id", "regulation", "article", "section", "clause", "new_superseded_by"), 256)
    return off.select(key.alias("event_id"), F.lit("supersession").alias("event_type"), now.alias("timestamp"), F.lit("internal").alias("request_id"), F.lit("system").alias("key_id"), F.lit("internal:index").alias("endpoint"), F.lit("mark_superseded").alias("action"), F.lit("success").alias("status"), "document_id", meta.alias("regulation_metadata"))


def auth_failures(requests: DataFrame, now: Column) -> DataFrame:
    """An event for each request (request_id, key_id, endpoint, error) that was refused."""
    return requests.select(F.sha2(F.concat_ws("|", "request_id", "key_id"), 256).alias("event_id"), F.lit("auth_failure").alias("event_type"), now.alias("timestamp"), "request_id", "key_id", "endpoint", F.lit("authenticate").alias("action"), F.lit("failure").alias("status"), "error")


def rate_limit(events: DataFrame, limit: int, key: str = "user_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds minute and allowed: the first ``limit`` events of a key in each minute are; a limit of 0 or less allows all."""
    out = events.withColumn("minute", F.date_trunc("minute", F.col(time)))
    if limit <= 0:
        return out.withColumn("allowed", F.lit(True))
    return out.withColumn("allowed", F.row_number().over(W.partitionBy(key, "minute").orderBy(time, tie)) <= limit)


def counters(events: DataFrame) -> DataFrame:
    """(event_type, status, n, mean_ms)."""
    return events.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"))


def trace(queries: DataFrame, fused: DataFrame, final: DataFrame, subqueries: DataFrame | None = None, prompts: DataFrame | None = None) -> DataFrame:
    """One row per query: vector size and length, hits of both searches, fused, kept and saved, chunks that reranking
    dropped, and where given the share of sub-queries with hits and the prompt's size."""
    hits = fused.groupBy("query_id").agg(F.count("dense_rank").alias("dense_hits"), F.count("bm25_rank").alias("bm25_hits"), F.count("*").alias("fused"))
    kept = final.groupBy("query_id").agg(F.count("*").alias("sent"))
    dropped = fused.join(final.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("dropped"))
    vector = [F.size("embedding").alias("dimension"), F.round(norm(F.col("embedding")), 6).alias("vector_norm")] if "embedding" in queries.columns else []
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = queries.join(hits, "query_id", "left").join(kept, "query_id", "left").join(dropped, "query_id", "left")
    rest = [*map(zero, ("dense_hits", "bm25_hits", "fused", "sent")), (F.coalesce("fused", F.lit(0)) - F.coalesce("sent", F.lit(0))).alias("saved"), F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped")]
    out = out.select("query_id", *vector, *rest)
    if subqueries is not None:
        out = out.join(subqueries.groupBy("query_id").agg(F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("subquery_coverage")), "query_id", "left")
    if prompts is not None:
        out = out.join(prompts.select("query_id", F.length("prompt").alias("prompt_chars"), F.floor(F.length("prompt") / 4).alias("prompt_tokens")), "query_id", "left")
    return out


def pruning_trace(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, before, after, dropped) of ranked chunks (query_id, id) before and after pruning; dropped ones by rank."""
    kept = after.select("query_id", "id", F.lit(True).alias("_kept"))
    gone = F.transform(F.array_sort(F.collect_list(F.when(F.col("_kept").isNull(), F.struct("final_rank", "id")))), lambda s: s["id"])
    return before.select("query_id", "id", "final_rank").join(kept, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("before"), F.count("_kept").alias("after"), gone.alias("dropped"))


def provenance_trace(merged: DataFrame) -> DataFrame:
    """(query_id, id, primary_subquery, all_subqueries, shared): which sub-queries found a chunk; shared if several did."""
    return merged.select("query_id", "id", "primary_subquery", "all_subqueries", (F.size("all_subqueries") > 1).alias("shared"))


def generation_trace(drafts: DataFrame) -> DataFrame:
    """(query_id, raw_chars, parsed, claims, quotes, error) of drafts (query_id, raw, claims, error)."""
    quotes = F.size(F.filter("claims", lambda c: F.coalesce(c["supporting_quote"], F.lit("")) != ""))
    return drafts.select("query_id", F.length("raw").alias("raw_chars"), F.col("error").isNull().alias("parsed"), F.size("claims").alias("claims"), quotes.alias("quotes"), "error")


def verification_trace(report: DataFrame) -> DataFrame:
    """(query_id, total, verified, failed, ratio) of verification reports; the ratio of no claims is 0."""
    ratio = F.when(F.col("total_claims") > 0, F.col("verified_claims") / F.col("total_claims")).otherwise(0.0)
    return report.select("query_id", F.col("total_claims").alias("total"), F.col("verified_claims").alias("verified"), F.col("failed_claims").alias("failed"), F.round(ratio, 6).alias("ratio"))


def write_traces(traces: DataFrame, path: str) -> None:
    """One JSON object per request."""
    traces.write.mode("append").json(path)
