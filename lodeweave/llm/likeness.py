"""Word multisets of texts and what is computed from them: keys, sketches and the exact likeness of pairs.

A text is the set of its (word, occurrence) features, so that the likeness of two texts, with repeated words counted, is
the Jaccard similarity of two sets. A sketch has a bit for each of SKETCH_BITS parts of the feature domain: whether the
number of features in it is odd. A feature that only one text has changes one bit, so the bits that differ are never more
than the features that differ: what sketches rule out is never a sufficiently similar pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp

LEAST_WORDS, MOST_WORDS = 20, 400
SKETCH_BITS = 256


class Sets:
    """The feature sets of the texts of a batch that have LEAST_WORDS to MOST_WORDS words; row i of them is texts[rows[i]]."""

    def __init__(self, texts: list[str | None], least: int = LEAST_WORDS, most: int = MOST_WORDS):
        of, word = cp.words(texts)
        sizes = np.bincount(of, minlength=len(texts))
        fits = (sizes >= least) & (sizes <= most)
        number = np.cumsum(fits) - 1
        of, word = number[of[fits[of]]], word[fits[of]]
        order = np.lexsort((word, of))
        of, word = of[order], word[order]
        first = np.append(True, (of[1:] != of[:-1]) | (word[1:] != word[:-1]))[: len(of)]
        place = np.arange(len(of))
        nth = place - np.maximum.accumulate(np.where(first, place, 0)) if len(of) else place
        self.rows = np.flatnonzero(fits)
        self.sizes = sizes[fits].astype(np.int64)
        self.of, self.features = of, cp.mix64(word + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        total = np.zeros(len(self.rows), np.uint64)
        np.add.at(total, of, self.features)
        self.keys = cp.mix64(total + self.sizes.astype(np.uint64)).view(np.int64)

    @classmethod
    def of_rows(cls, keys: pa.Array, blobs: pa.Array) -> Sets:
        """The sets of stored (_key, _features) rows, each key once (the first of a batch)."""
        s = cls([])
        every = keys.to_numpy(zero_copy_only=False)
        s.rows = np.sort(np.unique(every, return_index=True)[1])
        s.keys = every[s.rows]
        values = blobs.take(pa.array(s.rows))
        flat = np.frombuffer(b"".join(values.to_pylist()), "<u4")
        s.sizes = np.fromiter((len(v) // 4 for v in values.to_pylist()), np.int64, len(values))
        s.of, s.features = np.repeat(np.arange(len(s.rows)), s.sizes), cp.mix64(flat.astype(np.uint64))
        return s

    def select(self, kept: np.ndarray) -> None:
        """Keep some of the rows (a mask)."""
        number = np.cumsum(kept) - 1
        inside = kept[self.of]
        self.of, self.features = number[self.of[inside]], self.features[inside]
        self.rows, self.sizes, self.keys = self.rows[kept], self.sizes[kept], self.keys[kept]

    def sketches(self) -> np.ndarray:
        """(rows, SKETCH_BITS / 64) uint64."""
        part = (self.features >> np.uint64(7)) % np.uint64(SKETCH_BITS)
        counts = np.bincount(self.of * SKETCH_BITS + part.astype(np.int64), minlength=len(self.rows) * SKETCH_BITS)
        return np.packbits(counts.reshape(len(self.rows), SKETCH_BITS) & 1, axis=1).view(np.uint64)

    def blobs(self) -> pa.Array:
        """The features of each row as sorted 32-bit numbers."""
        small = (self.features >> np.uint64(32)).astype("<u4")
        order = np.lexsort((small, self.of))
        offsets = np.concatenate([[0], np.cumsum(self.sizes)]) * 4
        return pa.Array.from_buffers(pa.binary(), len(self.rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(small[order].tobytes())])


def most_bits(threshold: float, most: int = MOST_WORDS) -> np.ndarray:
    """How many features, so how many sketch bits, may differ, by the sum of two sizes, for a likeness of at least the threshold."""
    return np.floor(np.arange(2 * most + 1) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)


class Entries:
    """Sizes and sketches of texts as contiguous columns, and which pairs of them may reach a threshold."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray, threshold: float):
        self.threshold, self.allowed = threshold, most_bits(threshold)
        self.sizes = sizes.astype(np.int64)
        self.words = [np.ascontiguousarray(sketches[:, k]) for k in range(sketches.shape[1])]

    def fit(self, small: np.ndarray, large: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """A mask of pairs of sizes, in order, whose sketches differ in so many bits."""
        return (small >= self.threshold * large - 1e-9) & (differ <= self.allowed[np.minimum(small + large, len(self.allowed) - 1)])

    def close(self, i: np.ndarray, other: Entries, j: np.ndarray) -> np.ndarray:
        """A mask of the pairs (i of these, j of the others)."""
        differ = np.zeros(len(i), np.uint16)
        for a, b in zip(self.words, other.words, strict=True):
            differ += np.bitwise_count(a[i] ^ b[j])
        near = np.flatnonzero(differ <= self.allowed[-1])
        x, y = self.sizes[i[near]], other.sizes[j[near]]
        ok = np.zeros(len(i), bool)
        ok[near] = self.fit(np.minimum(x, y), np.maximum(x, y), differ[near])
        return ok

    def within(self, start: int, n: int, small: int, tile: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that may reach the threshold of a run in order of size: of its first ``small`` with all after them."""
        end = start + n
        for a in range(start, start + small, tile[0]):
            b = min(a + tile[0], start + small)
            high = start + int(self.sizes[start:end].searchsorted(self.sizes[b - 1] / self.threshold + 1e-6, "right"))
            for c in range(a, high, tile[1]):
                i, j = self._tile(a, b, self, c, min(c + tile[1], high))
                if len(i):
                    after = i < j
                    yield i[after], j[after]

    def across(self, other: Entries, small: int, others: int, tile: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs (i of these, j of the others) that may reach the threshold, both in order of size, each of one of the
        first ``small`` of these or ``others`` of the others."""
        for a in range(0, len(self.sizes), tile[0]):
            b = min(a + tile[0], len(self.sizes))
            low = int(other.sizes.searchsorted(self.sizes[a] * self.threshold - 1e-6, "left"))
            high = int(other.sizes.searchsorted(self.sizes[b - 1] / self.threshold + 1e-6, "right"))
            if a >= small:  # larger ones meet the smaller of the others alone
                high = min(high, others)
            for c in range(low, high, tile[1]):
                i, j = self._tile(a, b, other, c, min(c + tile[1], high))
                one = (i < small) | (j < others)
                yield i[one], j[one]

    def _tile(self, a: int, b: int, other: Entries, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        differ = np.zeros((b - a, d - c), np.uint8)  # may pass 255 by one, which only lets a pair through
        for x, y in zip(self.words, other.words, strict=True):
            differ += np.bitwise_count(x[a:b, None] ^ y[None, c:d])
        hit = np.flatnonzero(differ <= self.allowed[min(self.sizes[b - 1] + other.sizes[d - 1], len(self.allowed) - 1)])
        i, j = np.divmod(hit, d - c)
        i, j = i + a, j + c
        x, y = self.sizes[i], other.sizes[j]
        ok = self.fit(np.minimum(x, y), np.maximum(x, y), differ.ravel()[hit])
        return i[ok], j[ok]


def text_rows(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """(id columns, _key, _n, _features) of the rows whose text has 20 to 400 words. Texts with equal words, however ordered, share a key."""

    @F.arrow_udf("struct<k:bigint,n:int,f:binary>")
    def features(texts: pa.Array) -> pa.Array:
        values, keys, sizes, blobs = texts.to_pylist(), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32), [None] * len(texts)
        for a, b in cp.slices(values):
            s = Sets(values[a:b])
            keys[a + s.rows], sizes[a + s.rows] = s.keys, s.sizes
            for i, f in zip((a + s.rows).tolist(), s.blobs().to_pylist(), strict=True):
                blobs[i] = f
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(sizes), pa.array(blobs, pa.binary())], ["k", "n", "f"])

    rows = df.select(*id_cols, features(F.col(text_col)).alias("_s")).filter("_s.n > 0")
    return rows.select(*id_cols, F.col("_s.k").alias("_key"), F.col("_s.n").alias("_n"), F.col("_s.f").alias("_features"))


BITMAP = 1 << 24  # bits of the filter on keys: 2 MB whatever the data; if it fills up it only filters less


def key_bitmap(keys: DataFrame) -> bytes:
    """A bitmap of fixed size of the column _key: which places its keys fall on."""
    place = F.pmod(F.col("_key"), F.lit(BITMAP))
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # at most 513 rows of 4 kB
    out = np.zeros((BITMAP // 32768 + 2, 4096), np.uint8)
    for b, m in rows:
        out[b] = np.frombuffer(bytes(m), np.uint8)
    return out.tobytes()


def feature_rows(rows: DataFrame, bitmap: bytes) -> DataFrame:
    """(_key, _n, _features), one row for each key that may be among those of the bitmap; only these are shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            p = keys % BITMAP
            # a bucket holds the places 32768 b - 32767 .. 32768 b, as bitmap_bucket_number counts from 1 for positive places
            bucket, bit = np.where(p > 0, 1 + (p - 1) // 32768, 0), np.where(p > 0, (p - 1) % 32768, 0)
            kept = (bits[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            kept &= first
            kept[kept] = [not (k in seen or seen.add(k)) for k in keys[kept].tolist()]
            yield b.filter(pa.array(kept))

    kept = rows.select("_key", "_n", "_features").mapInArrow(run, "_key bigint, _n int, _features binary")
    return kept.groupBy("_key").agg(F.first("_n").alias("_n"), F.first("_features").alias("_features"))


def shared_features(a: Column, b: Column) -> Column:
    """How many features two blobs share."""

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        parts = []
        for v in (x, y):
            sizes = np.fromiter(map(len, v.to_pylist()), np.int64, len(v)) if len(v) < 2 else np.diff(np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64))
            flat = np.frombuffer(b"".join(v.to_pylist()), "<u4").astype(np.uint64)
            parts.append((np.repeat(np.arange(len(v), dtype=np.uint64), sizes // 4) << np.uint64(32)) | flat)
        both = np.sort(np.concatenate(parts), kind="stable")
        same = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
        return pa.array(np.bincount(same.astype(np.int64), minlength=len(x)).astype(np.int32))

    return run(a, b)


def verified(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs (_a, _b) of keys those whose exact likeness reaches the threshold, with it."""
    a = features.select(F.col("_key").alias("_a"), F.col("_n").alias("_na"), F.col("_features").alias("_fa"))
    b = features.select(F.col("_key").alias("_b"), F.col("_n").alias("_nb"), F.col("_features").alias("_fb"))
    return likeness_of(pairs.join(a, "_a").join(b, "_b")).select("_a", "_b", "likeness").filter(F.col("likeness") >= threshold)


def likeness_of(both: DataFrame) -> DataFrame:
    """Adds the exact likeness to pairs with both texts' sizes and features (_na, _nb, _fa, _fb), which go."""
    counted = both.withColumn("_both", shared_features(F.col("_fa"), F.col("_fb")))
    return counted.withColumn("likeness", F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).drop("_na", "_nb", "_fa", "_fb", "_both")
