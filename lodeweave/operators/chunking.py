"""Chunkers: one document in, many chunks out, all with stable ids and a document's running chunk_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chunk_key, cosine, sentences, strip
from ..session import cut

MAX_CHUNK_CHARS = 6000
#: Document types that the clause chunker takes; all others get the default one.
LEGAL_TYPES = ["regulation", "policy", "contract", "standard", "guideline"]


def sliding_window(text: Column, size: int, overlap: int) -> Column:
    """Array of windows that start at 0, step, 2 step, ... before the end, with step = size - overlap; rests are kept."""
    step = size - overlap
    if step <= 0 or size <= 0:
        raise ValueError("the overlap must be smaller than the size")
    n = F.ceil(F.length(text) / F.lit(step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def as_chunks(df: DataFrame, strategy: str, id_col: str = "document_id") -> DataFrame:
    """Chunk rows of (id_col, chunk_index, text, heading)."""
    return df.select(
        chunk_key(F.col(id_col), F.lit(strategy), F.col("chunk_index")).alias("chunk_id"),
        F.col(id_col).alias("document_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "text",
        F.lit(strategy).alias("strategy_version"),
        "heading",
        F.length("text").alias("char_count"),
    )


def chunk_fixed(df: DataFrame, size: int = 500, overlap: int = 150, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """Windows over the whole text, not stripped. Null and empty texts give no chunk; repeated rows repeat theirs."""
    windows = df.select(F.col(id_col), F.posexplode(sliding_window(F.col(text_col), size, overlap)).alias("chunk_index", "text"), F.lit(None).cast("string").alias("heading"))
    return as_chunks(windows, "fixed-v1", id_col)


def heading_sections(text: Column) -> Column:
    """Array of (heading, body), body stripped, in order; text before the first heading has a null heading; empty bodies are left out."""
    parts = F.split(text, r"(?dmU)(?=^#{1,6}\s+.+$)")
    head = lambda p: F.regexp_extract(p, r"(?dU)^(#{1,6}\s+.+)", 1)
    title = lambda p: F.when(head(p) != "", strip(F.regexp_extract(p, r"(?dU)^#{1,6}\s+(.+)", 1)))
    made = F.transform(parts, lambda p: F.struct(title(p).alias("heading"), strip(F.substring(p, F.length(head(p)) + 1, F.length(p))).alias("body")))
    return F.filter(made, lambda s: s["body"] != "")


def chunk_recursive(df: DataFrame, size: int = 500, overlap: int = 150, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """Sections under markdown headings, windowed if longer than ``size``; the index goes on across sections. No shuffle."""
    pieces = F.transform(
        heading_sections(F.col(text_col)),
        lambda s: F.transform(
            F.when(F.length(s["body"]) <= size, F.array(s["body"])).otherwise(sliding_window(s["body"], size, overlap)),
            lambda t: F.struct(s["heading"].alias("heading"), t.alias("text")),
        ),
    )
    rows = df.select(F.col(id_col), F.posexplode(F.flatten(pieces)).alias("chunk_index", "_p")).select(id_col, "chunk_index", "_p.text", "_p.heading")
    return as_chunks(rows, "recursive-v1", id_col)


def islands(df: DataFrame, key: str, order: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """Adds `island`: the number (from 0) of the run of neighbours within a key whose cosine to the one before is at least the threshold.

    Keys may be few and large: rows are first sorted as a whole into ranges of (key, order), and runs are numbered within a
    range; the few numbers of a range (its first and last row of each key, and how many runs begin) join ranges together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, key, order).sortWithinPartitions(key, order).withColumn("_range", F.spark_partition_id()), "islands")
    inside = W.partitionBy(key, "_range").orderBy(order)
    apart = lambda a, b: (F.round(cosine(a, b), 6) < threshold).cast("int")
    local = ranged.withColumn("_new", F.coalesce(apart(F.lag(vector).over(inside), F.col(vector)), F.lit(0)))
    ends = local.groupBy(key, "_range").agg(F.sum("_new").alias("_n"), F.min_by(vector, order).alias("_first"), F.max_by(vector, order).alias("_last"))
    across = W.partitionBy(key).orderBy("_range")  # at most a row per range and key
    starts = ends.withColumn("_join", F.coalesce(apart(F.lag("_last").over(across), F.col("_first")), F.lit(0)))
    base = starts.withColumn("_base", F.sum("_join").over(across.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(key).alias("_k"), F.col("_range").alias("_r"), "_base")
    joined = local.join(base, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("island", (F.col("_base") + F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))).cast("int")).select(*df.columns, "island")


def chunk_semantic(df: DataFrame, embed, threshold: float = 0.5, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """Runs of sentences of like meaning, joined by a space. ``embed`` makes a vector column of a text column (a provider)."""
    rows = df.select(F.col(id_col).alias("_id"), F.posexplode(sentences(F.col(text_col))).alias("_n", "_s")).withColumn("_v", embed(F.col("_s")))
    runs = islands(rows, "_id", "_n", "_v", threshold).groupBy("_id", "island").agg(F.sort_array(F.collect_list(F.struct("_n", "_s"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["_s"]), " ")
    return as_chunks(runs.select(F.col("_id").alias(id_col), F.col("island").alias("chunk_index"), text.alias("text"), F.lit(None).cast("string").alias("heading")), "semantic-v1", id_col)


def pack_paragraphs(text: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Array of pieces of at most ``limit`` characters: paragraphs packed greedily, a larger paragraph sliced hard."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        longer = F.when(s["now"] != "", F.concat(s["now"], F.lit("\n\n"), p)).otherwise(p)
        fits = F.length(longer) <= limit
        before = F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        sliced = F.concat(before, sliding_window(p, limit, 0))
        return F.struct(
            F.when(fits, s["done"]).when(F.length(p) <= limit, before).otherwise(sliced).alias("done"),
            F.when(fits, longer).when(F.length(p) <= limit, p).otherwise(F.lit("")).alias("now"),
        )

    packed = F.aggregate(F.split(text, "\n\n"), start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_paragraphs(df: DataFrame, limit: int = MAX_CHUNK_CHARS, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    rows = df.select(F.col(id_col), F.posexplode(pack_paragraphs(F.col(text_col), limit)).alias("chunk_index", "text"), F.lit(None).cast("string").alias("heading")).filter("text <> ''")
    return as_chunks(rows, "paragraph-v1", id_col)


def by_document_type(df: DataFrame, legal, general, type_col: str = "document_type") -> DataFrame:
    """Chunks of both kinds: ``legal`` takes the rows of legal types, ``general`` all others, those of no type too."""
    is_legal = F.coalesce(F.col(type_col).isin(LEGAL_TYPES), F.lit(False))
    return legal(df.filter(is_legal)).unionByName(general(df.filter(~is_legal)), allowMissingColumns=True)
