"""Pages of words with places: two-column detection and reading order; tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, LEFT, RIGHT, LEAST_WORDS, LEAST_SHARE = 26, 0.35, 0.65, 20, 0.25


def gutters(words: DataFrame) -> DataFrame:
    """(page_id, gutter) of words (page_id, width, x0, x1): the place between two columns, null if the page has one.

    Of 26 places in the middle third the first that fewest words cross, if at most max(2, 2 %) do, at least a quarter of
    the words lie on either side, and the page has 20 words."""
    x = [F.col("width") * (LEFT + (RIGHT - LEFT) * i / (STEPS - 1)) for i in range(STEPS)]
    count = lambda c: F.sum(c.cast("int"))
    # one aggregate per place, so that words are neither multiplied nor shuffled
    sums = words.groupBy("page_id").agg(
        F.count("*").alias("n"),
        F.array(*[F.struct(F.lit(i).alias("i"), F.first(x[i]).alias("x"), count((F.col("x0") < x[i]) & (F.col("x1") > x[i])).alias("crossing"), count(F.col("x1") <= x[i]).alias("before"), count(F.col("x0") >= x[i]).alias("after")) for i in range(STEPS)]).alias("_s"),
    )
    counts = sums.select("page_id", "n", F.explode("_s").alias("_e")).select("page_id", "n", "_e.*")
    fair = (F.col("before") >= LEAST_SHARE * F.col("n")) & (F.col("after") >= LEAST_SHARE * F.col("n"))
    best = counts.groupBy("page_id").agg(F.first("n").alias("n"), F.min(F.when(fair, F.struct("crossing", "i", "x"))).alias("_b"))
    ok = (F.col("n") >= LEAST_WORDS) & (F.col("_b.crossing") <= F.greatest(F.lit(2), F.floor(0.02 * F.col("n"))))
    return best.select("page_id", F.when(ok, F.round("_b.x", 6)).alias("gutter"))


def page_texts(words: DataFrame, lines: str = "top") -> DataFrame:
    """(page_id, text): words (page_id, width, x0, x1, top, word) in reading order, the left column before the right one."""
    g = words.join(gutters(words), "page_id")
    side = F.when(F.col("gutter").isNotNull() & ((F.col("x0") + F.col("x1")) / 2 >= F.col("gutter")), 1).otherwise(0)
    row = g.groupBy("page_id", side.alias("_side"), F.col(lines).alias("_top")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word"))), lambda s: s["word"]), " ").alias("_line"))
    return row.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_side", "_top", "_line"))), lambda s: s["_line"]), "\n").alias("text"))


def table_text(rows: Column) -> Column:
    """An array of rows of cells as `cell | cell` lines; null cells are empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
