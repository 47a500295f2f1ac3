"""The pN_ queries of this subpackage and, where SQL can state the result, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, ensure_importable, spread, table
from .forest import repeated_arrivals
from .languages import label_languages
from .neardup import near_duplicate_groups, near_duplicates
from .packing import pack
from .splitting import LIMIT, OVERLAP, split_oversized
from .tokens import decoded, encode_corpus, token_count
from .vectors import nearest, similar_pairs


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    parts = [("document", "source_documents", "document_id", "content"), ("chunk", "chunks", "chunk_id", "text")]
    once = lambda df, key, text: df.filter(F.length(text) > LIMIT).dropDuplicates([key]) if with_text else df  # noqa: E731  of the oversized rows alone
    docs, chunks = (
        split_oversized(once(spread(table(spark, sf_dir, name).select(key, text)), key, text), key, text, with_text=with_text).select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), "piece_no", "start", "end", "cut", *["text"] * with_text)
        for kind, name, key, text in parts
    )
    return docs.unionByName(chunks)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized document and chunk, with its text; repeated items once."""
    return _pieces(spark, sf_dir, True)


def p1_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized item, whether its pieces keep the limit, follow each other without a gap and with the overlap, and end it."""
    w = W.partitionBy("item_kind", "item_id").orderBy("piece_no")
    p = p1_pieces(spark, sf_dir).withColumn("_before", F.lag("end").over(w)).withColumn("_text", F.lag("text").over(w))
    repeated = F.col("_before") - F.col("start")
    follows = F.col("_before").isNull() & (F.col("start") == 0) | repeated.between(0, OVERLAP) & (F.expr("right(_text, cast(_before - start as int))") == F.expr("left(text, cast(_before - start as int))"))
    return p.groupBy("item_kind", "item_id").agg(F.max("end").cast("bigint").alias("n_chars"), F.bool_and(F.length("text") <= LIMIT).alias("within_limit"), F.bool_and(follows & (F.length("text") == F.col("end") - F.col("start"))).alias("in_order"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that splitting cut."""
    return _pieces(spark, sf_dir, False).filter("piece_no = 1").select("item_kind", "item_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of chunks whose texts are alike."""
    return near_duplicates(spread(table(spark, sf_dir, "chunks").select("chunk_id", "text")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and group of every chunk whose text takes part."""
    return near_duplicate_groups(spread(table(spark, sf_dir, "chunks").select("chunk_id", "text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that repeat something stored or accepted before, batch after batch."""
    return repeated_arrivals(spread(table(spark, sf_dir, "chunks").select("text")), spread(table(spark, sf_dir, "incoming_chunks").select("arrival_no", "batch_no", "text")), batch_col="batch_no")


def p4_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that join the accepted ones, with their batch."""
    came = table(spark, sf_dir, "incoming_chunks").select("arrival_no", "batch_no", "chunk_id").dropDuplicates(["arrival_no"])
    return came.join(p4_found(spark, sf_dir), "arrival_no", "left_anti")


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector."""
    return nearest(table(spark, sf_dir, "embedding_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near neighbours with a cosine of at least 0.90."""
    return similar_pairs(p5_nearest(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as its ids give it back."""
    return p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_ids"), decoded("ids").alias("text")).select("doc_id", (F.col("n_ids") > 0).alias("has_ids"), "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container."""
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", token_count("text").alias("n_tokens")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers used, the least possible by total size, and the share of room left."""
    return p7_containers(spark, sf_dir).filter("container_id is not null").agg(
        F.countDistinct("container_id").alias("containers"),
        F.ceil(F.sum("size") / 2048).alias("lower_bound"),
        F.round(1 - F.sum("size") / (2048 * F.countDistinct("container_id")), 6).alias("unused_share"),
    )


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, whether its pieces make up its tokens, only an oversized one was split, and its containers hold no more than they may."""
    d = cut(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", token_count("text").alias("n_tokens")), "tokens")
    placed = cut(pack(d), "packed")
    fits = placed.groupBy("container_id").agg((F.sum("size") <= 2048).alias("fits"))
    each = placed.join(fits, "container_id", "left").groupBy("doc_id").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"), F.bool_and(F.coalesce("fits", F.lit(True))).alias("fits"))
    whole = (F.col("_sum") == F.col("n_tokens")) & (F.col("_n") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / 2048)))
    return d.join(each, "doc_id").select("doc_id", whole.alias("whole"), "fits")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that packing had to split: exactly those of more than 2048 tokens."""
    return p7_containers(spark, sf_dir).filter("seg_no = 1").select("doc_id").distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return label_languages(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), table(spark, sf_dir, "language_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents whose label is missing or wrong, or that are in more than one language."""
    return p8_segments(spark, sf_dir).filter("label_state <> 'ok' or n_segments > 1").select("doc_id", "seg_no", "lang")


QUERIES = {
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p4_found": p4_found,
    "p4_accepted": p4_accepted,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_checked": p1_checked,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
    "p6_ids": p6_ids, "p6_round": p6_round, "p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checked": p7_checked}
#: Arrivals in their order; the list of accepted ones goes from one to the next.
_ACCEPTED = """
    WITH RECURSIVE texts AS (SELECT DISTINCT no, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM (SELECT -1 AS no, text FROM chunks UNION ALL SELECT arrival_no, text FROM incoming_chunks) WHERE text IS NOT NULL AND no IS NOT NULL),
    used AS MATERIALIZED (SELECT row_number() OVER () AS t, no, ws, len(ws) AS n FROM texts WHERE len(ws) BETWEEN 20 AND 400),
    counted AS (SELECT t, no, w, count(*) AS c FROM (SELECT t, no, unnest(ws) AS w FROM used) GROUP BY ALL),
    both_ AS (SELECT a.t AS x, b.t AS y, sum(least(a.c, b.c)) AS s FROM counted a JOIN counted b ON a.w = b.w AND a.no >= 0 AND b.no < a.no GROUP BY ALL),
    alike AS (SELECT a.no AS no, b.no AS other FROM both_ JOIN used a ON a.t = x JOIN used b ON b.t = y WHERE s >= 0.7 * (a.n + b.n - s)),
    links AS (SELECT u.no, coalesce(list(DISTINCT l.other) FILTER (l.other IS NOT NULL), []) AS earlier, row_number() OVER (ORDER BY u.no) AS k FROM used u LEFT JOIN alike l ON l.no = u.no WHERE u.no >= 0 GROUP BY u.no),
    steps AS (SELECT 0::BIGINT AS k, [-1]::BIGINT[] AS accepted
        UNION ALL SELECT s.k + 1, CASE WHEN list_has_any(l.earlier, s.accepted) THEN s.accepted ELSE list_append(s.accepted, l.no) END FROM steps s JOIN links l ON l.k = s.k + 1),
    last AS (SELECT accepted FROM steps ORDER BY k DESC LIMIT 1),
    found AS (SELECT no FROM links, last WHERE NOT list_contains(accepted, no))"""
SQL: dict[str, str] = {
    "p4_found": _ACCEPTED + " SELECT no AS arrival_no FROM found",
    "p4_accepted": _ACCEPTED + " SELECT DISTINCT ON (arrival_no) arrival_no, batch_no, chunk_id FROM incoming_chunks WHERE arrival_no NOT IN (SELECT no FROM found)",
    "p1_found": """
        SELECT DISTINCT 'document' AS item_kind, document_id AS item_id FROM source_documents WHERE length(content) > 6000
        UNION ALL
        SELECT DISTINCT 'chunk', chunk_id FROM chunks WHERE length(text) > 6000
    """,
    "p1_checked": """SELECT DISTINCT 'document' AS item_kind, document_id AS item_id, length(content) AS n_chars, TRUE AS within_limit, TRUE AS in_order FROM source_documents WHERE length(content) > 6000
        UNION ALL SELECT DISTINCT 'chunk', chunk_id, length(text), TRUE, TRUE FROM chunks WHERE length(text) > 6000""",
    "p7_checked": "SELECT doc_id, TRUE AS whole, TRUE AS fits FROM documents",
    "p6_round": "SELECT doc_id, coalesce(text, '') <> '' AS has_ids, coalesce(text, '') AS text FROM documents",
    "p2_found": """
        WITH texts AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        used AS (SELECT row_number() OVER () AS t, chunk_id, ws, len(ws) AS n FROM texts WHERE len(ws) BETWEEN 20 AND 400),
        counted AS (SELECT t, w, count(*) AS c FROM (SELECT t, unnest(ws) AS w FROM used) GROUP BY ALL),
        both_ AS (SELECT a.t AS x, b.t AS y, sum(least(a.c, b.c)) AS s FROM counted a JOIN counted b ON a.w = b.w AND a.t < b.t GROUP BY ALL)
        SELECT DISTINCT least(a.chunk_id, b.chunk_id) AS chunk_id_a, greatest(a.chunk_id, b.chunk_id) AS chunk_id_b
        FROM both_ JOIN used a ON a.t = x JOIN used b ON b.t = y
        WHERE a.chunk_id <> b.chunk_id AND s >= 0.7 * (a.n + b.n - s)
    """,
}


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, sf_dir)

        return run

    return {k: shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
