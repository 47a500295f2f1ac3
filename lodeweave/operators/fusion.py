"""Fusion, reranking, merging, pruning, neighbours: what happens to hit lists between search and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reciprocal_rank, tokens

RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.7, 0.3
FUSED_BUDGET, TOP_N, FREQUENCY_BONUS = 8, 5, 0.15


def weighted_rrf(dense: DataFrame, sparse: DataFrame, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, k: int = RRF_K) -> DataFrame:
    """(query_id, id, dense_score, dense_rank, bm25_score, bm25_rank, rrf_score, fused_rank) of all hits of either list.

    Inputs: (query_id, id, score, rank). Ranked by score of nine decimals, then dense rank, then sparse rank, missing last."""
    a = dense.select("query_id", "id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    part = lambda w, c: F.coalesce(reciprocal_rank(w, F.col(c), k), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("rrf_score", F.round(part(dense_weight, "dense_rank") + part(sparse_weight, "bm25_rank"), 9))
    w = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    return both.withColumn("fused_rank", F.row_number().over(w))


def passthrough(fused: DataFrame, budget: int = FUSED_BUDGET, top_n: int = TOP_N) -> DataFrame:
    """The first top_n of the fused budget, with a null rerank_score."""
    return fused.filter(F.col("fused_rank") <= min(budget, top_n)).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col("fused_rank"))


def lexical_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a model's relevance score: how much of the question's words the text has, as a logit-like number."""
    q = F.array_distinct(tokens(question))
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))
    return F.round(8 * share - 4, 6)


def rerank(fused: DataFrame, score: Column, budget: int = FUSED_BUDGET, top_n: int = TOP_N) -> DataFrame:
    """The budget's hits by a score (any Column, a provider's UDF too), then by fused rank; the top_n first."""
    w = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    scored = fused.filter(F.col("fused_rank") <= budget).withColumn("rerank_score", score)
    return scored.withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= top_n)


def hydrate(hits: DataFrame, chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with their chunks' columns; hits of unknown chunks are dropped."""
    return hits.join(chunks.withColumnRenamed("chunk_id", id_col), id_col)


def restrict(hits: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Only hits whose keys are among the allowed ones."""
    return hits.join(allowed.select(*keys).distinct(), keys, "left_semi")


def merge_subqueries(hits: DataFrame) -> DataFrame:
    """One list per question of (query_id, sub_id, id, rerank_score) hits: the best score, how often and by which
    sub-queries a chunk was found, and the rank by best score + 0.15 log2(appearances); chunks without score last."""
    merged = hits.groupBy("query_id", "id").agg(
        F.max("rerank_score").alias("rerank_score"),
        F.count("*").alias("appearances"),
        F.min("sub_id").alias("primary_subquery"),
        F.sort_array(F.collect_set("sub_id")).alias("all_subqueries"),
    )
    combined = F.round(F.coalesce("rerank_score", F.lit(0.0)) + FREQUENCY_BONUS * F.log2(F.col("appearances").cast("double")), 6)
    w = W.partitionBy("query_id").orderBy(F.col("rerank_score").isNull(), F.desc("combined_score"), "primary_subquery", "id")
    return merged.withColumn("combined_score", combined).withColumn("final_rank", F.row_number().over(w))


def prune(ranked: DataFrame, margin: float = 0.5, min_keep: Column | int = 1) -> DataFrame:
    """Rows of (query_id, final_rank, rerank_score) within ``margin`` of the spread of scores below the first one, at
    least min_keep. Nothing is pruned where a score is missing, there are fewer than two rows, or all are equal."""
    every = W.partitionBy("query_id")
    first = F.first("rerank_score").over(every.orderBy("final_rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    spread = first - F.min("rerank_score").over(every)
    idle = (F.count("*").over(every) < 2) | (F.count(F.when(F.col("rerank_score").isNull(), 1)).over(every) > 0) | (spread <= 0)
    kept = F.col("rerank_score") >= first - margin * spread
    count = F.sum(F.col("_kept").cast("int")).over(every)
    rows = ranked.withColumn("_idle", idle).withColumn("_kept", F.coalesce(kept, F.lit(False)))
    floor = min_keep if isinstance(min_keep, Column) else F.lit(min_keep)
    return rows.withColumn("_n", count).filter(F.col("_idle") | F.when(F.col("_n") < floor, F.col("final_rank") <= floor).otherwise(F.col("_kept"))).drop("_idle", "_kept", "_n")


def least_kept(comparative: Column, subqueries: Column) -> Column:
    """How many chunks pruning keeps at least: three for comparative questions, and one per sub-query."""
    return F.greatest(F.when(comparative, 3).otherwise(1), subqueries)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits (query_id, document_id, chunk_index, final_rank, rerank_score) with the chunks next to them, in reading order
    after their parent: (query_id, document_id, chunk_index, final_rank, rerank_score, is_neighbour, ord).

    A neighbour has its parent's final_rank and no score, comes once per query (with its first parent), and never if it is
    a hit itself. The offsets are exploded, so that the range join is an equi-join on (document, index)."""
    offsets = [o for o in range(-window, window + 1) if o]
    keys = ["query_id", "document_id", "chunk_index"]
    parents = hits.select(*keys, "final_rank", "rerank_score")
    wanted = parents.select("query_id", "document_id", F.col("chunk_index").alias("_at"), "final_rank", F.explode(F.array(*map(F.lit, offsets))).alias("_o")).withColumn("chunk_index", F.col("_at") + F.col("_o"))
    there = wanted.join(chunks.select("document_id", "chunk_index").distinct(), ["document_id", "chunk_index"], "left_semi").join(parents, keys, "left_anti")
    once = there.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("final_rank", "_o"))).filter("_rn = 1")
    near = once.select(*keys, "final_rank", F.lit(None).cast("double").alias("rerank_score"), F.lit(True).alias("is_neighbour"), F.col("_o").alias("_k"), F.lit(1).alias("_second"))
    own = parents.select(*keys, "final_rank", "rerank_score", F.lit(False).alias("is_neighbour"), F.lit(0).alias("_k"), F.lit(0).alias("_second"))
    w = W.partitionBy("query_id").orderBy("final_rank", "_second", "_k", "document_id", "chunk_index")
    return own.unionByName(near).withColumn("ord", F.row_number().over(w)).drop("_k", "_second")


def stage_dump(hits: DataFrame, score: str) -> DataFrame:
    """Hits of one stage in falling order of its score, missing ones as 0, with a preview of the text if there is one."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.coalesce(F.col(score), F.lit(0.0))), "id")
    out = hits.withColumn("stage_rank", F.row_number().over(w))
    return out.withColumn("preview", F.substring("text", 1, 120)) if "text" in hits.columns else out
