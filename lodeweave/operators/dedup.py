"""Duplicates as an index sees them: like vectors and like texts, against the store and within a document."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udf import lazy_pandas_udf
from ..session import cut
from .dense import scores, scores_within

COSINE, RATIO = 0.95, 0.9


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


@lazy_pandas_udf("double")
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks; not symmetric, the new text comes first."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def near_vectors(new: DataFrame, store: DataFrame, cosine_above: float, model_col: str | None = None) -> DataFrame:
    """(query_id, id): pairs of chunks whose vectors, of one model where model_col names it, have a greater cosine; once each."""
    one = lambda q, v: scores(q.select(F.col("chunk_id").alias("query_id"), "embedding"), v.select(F.col("chunk_id").alias("id"), "embedding"), above=cosine_above).select("query_id", "id")
    if model_col is None:
        return one(new, store)
    models = sorted(r[0] for r in new.select(model_col).distinct().collect() if r[0] is not None)
    pairs = [one(new.filter(F.col(model_col) == m), store.filter(F.col(model_col) == m)) for m in models]
    return reduce(DataFrame.unionByName, pairs).distinct() if pairs else one(new.limit(0), store.limit(0))


def _texts(chunks: DataFrame, columns: list[str], model_col: str | None) -> DataFrame:
    """Each chunk once, whatever models it has vectors of."""
    return chunks.select(*columns).dropDuplicates(["chunk_id"]) if model_col else chunks.select(*columns)


def similar_to_store(new: DataFrame, store: DataFrame, cosine_above: float = COSINE, ratio_above: float = RATIO, model_col: str | None = None) -> DataFrame:
    """(chunk_id, other): chunks (chunk_id, text, embedding) with a stored one of strictly greater cosine and text ratio.
    The cheap exact test of vectors comes first, the texts of its pairs alone are compared. With model_col a chunk has a
    row for each model it has a vector of, and vectors are compared within a model."""
    near = near_vectors(new, store, cosine_above, model_col)
    a = _texts(new, ["chunk_id", "text"], model_col).toDF("chunk_id", "_a")
    b = _texts(store, ["chunk_id", "text"], model_col).toDF("other", "_b")
    texts = near.select(F.col("query_id").alias("chunk_id"), F.col("id").alias("other")).filter("chunk_id <> other").join(a, "chunk_id").join(b, "other")
    return texts.filter(text_ratio("_a", "_b") > ratio_above).select("chunk_id", "other")


def repeats_within(new: DataFrame, cosine_above: float = COSINE, ratio_above: float = RATIO, model_col: str | None = None) -> DataFrame:
    """(chunk_id) of chunks that repeat an earlier surviving chunk of their document (by chunk_index).

    Only vectors of one document, and of one model, are compared; the greedy choice then streams through each document's pairs, sorted by the
    later chunk, and remembers the dropped ones alone."""
    near = scores_within(new, ["document_id", *([model_col] if model_col else [])], cosine_above, "chunk_index", "chunk_id").toDF("query_id", "id").distinct()
    own = _texts(new, ["chunk_id", "document_id", "chunk_index", "text"], model_col)
    a = own.toDF("query_id", "_d", "_i", "_a")
    b = own.toDF("id", "_e", "_j", "_b")
    pairs = near.join(a, "query_id").join(b, "id").filter("_d = _e and _j < _i").filter(text_ratio("_a", "_b") > ratio_above)
    ordered = pairs.select("_d", "_i", "_j", F.col("query_id").alias("chunk_id"), F.col("id").alias("other")).repartition("_d").sortWithinPartitions("_d", "_i", "_j")

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, dropped = object(), set()
        for t in batches:
            out = []
            for d, late, early in zip(t["_d"], t["chunk_id"], t["other"], strict=True):
                if d != document:
                    document, dropped = d, set()
                if early not in dropped and late not in dropped:
                    dropped.add(late)
                    out.append(late)
            yield pd.DataFrame({"chunk_id": out})

    return ordered.mapInPandas(greedy, "chunk_id string")


def survivors(new: DataFrame, store: DataFrame, cosine_above: float = COSINE, ratio_above: float = RATIO, model_col: str | None = None) -> DataFrame:
    """New chunks that repeat neither the store nor an earlier survivor of their own document."""
    fresh = cut(new.join(similar_to_store(new, store, cosine_above, ratio_above, model_col).select("chunk_id").distinct(), "chunk_id", "left_anti"), "dedup-fresh")  # it is read several times
    return fresh.join(repeats_within(fresh, cosine_above, ratio_above, model_col), "chunk_id", "left_anti")
