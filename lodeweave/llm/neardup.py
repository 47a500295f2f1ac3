"""Problem 2: near-duplicate texts by PartEnum signatures.

A text is a set of features. Sets are banded by size, the feature domain is partitioned, and subsets of partitions are
enumerated, so that two sufficiently similar sets share a signature. The two levels of the scheme: a hash partitions the
domain into the parts of a band; within a part every feature is a partition of its own, and the subsets of PAIR of them
that a set fills are its signatures. A set need not enumerate all its features. Of two texts that reach the threshold
each lacks at most ``lost`` of the features of the other, a number that their sizes bound: a text takes its features,
rarest first, until its parts hold lost + 1 more than PAIR - 1 each. Whatever is lost, one part keeps PAIR features, and
the one of two texts that ends first on the common order has these in common with the other: no pair is missed. The order
comes from counts over all rows in a table of fixed size; it decides how many pairs are met by chance, never which are
found. A text signs in its own band as the smaller one, and as the larger one in the bands of the smaller texts it may be
like; only pairs of a smaller with a larger one are looked at.

Texts are first reduced to classes of equal word multisets. Signatures travel packed, many texts to a row, to the
partition that their hash names; equal ones are paired there, and pairs whose sizes or sketches rule them out never leave
the task. The pairs that do are verified exactly. A signature that may be of more than HOT texts, by the counts of its
features, is salted, so that none has to fit one task; of these, and of runs of more than RUN, every block is written
once, and the pairs of blocks are a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from . import codepoints as cp
from . import likeness as lk

THRESHOLD = 0.70
PAIR, SPARSE = 2, 0.16  # features of a signature; parts of a band by the sizes of its texts
COUNTS = 1 << 19  # places of the table of feature counts: 4 MB whatever the data
RUN, HOT = 50_000, 1_000_000
LONG, TILE = 64, (128, 256)  # runs from this length are paired in tiles
BUCKET_ROWS = 25_000  # texts whose signatures one partition pairs, on average, at most
COPIES = 5_000  # texts of equal words that one task pairs with each other, about
ENTRY = np.dtype([("key", "<i8"), ("size", "<u2"), ("sketch", "<u8", (lk.SKETCH_BITS // 64,))])
SIGNED = np.dtype([("signature", "<u4"), ("entry", "<u4")])  # entry: its number, and in the lowest bit whether it is the smaller one
BLOCKS = "_a bigint, _b bigint, _run bigint, _i int, _of int, _small int, _block binary"


def step(threshold: float) -> float:
    """Ratio of the sizes at the ends of a band: sizes that the threshold allows for are of one band or of neighbours."""
    return (1 + 1e-6) / threshold


class PartEnum:
    """Bands, their parts, and the signatures of sets: two that reach the threshold share one for sure."""

    def __init__(self, threshold: float = THRESHOLD, sparse: float = SPARSE):
        self.threshold, self.low = threshold, [float(lk.LEAST_WORDS)]
        while self.low[-1] * step(threshold) <= lk.MOST_WORDS:
            self.low.append(self.low[-1] * step(threshold))
        # few enough that a set that lacks all it may has PAIR in one part even if no part is empty
        self.parts = [max(1, min(round(sparse * a), int(threshold * a) - 2)) for a in self.low]

    def lost(self, sizes: np.ndarray, partner: np.ndarray) -> np.ndarray:
        """How many of its features a set may lack in a similar one that has at least the partner's size."""
        return sizes - np.ceil(self.threshold / (1 + self.threshold) * (sizes + partner) - 1e-9).astype(np.int64)

    def bands(self, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(band, sets that sign in it, whether as the smaller one, features they may lack) for each band."""
        for number, (a, b) in enumerate(zip(self.low, [*self.low[1:], np.inf], strict=True)):
            own = (sizes >= a) & (sizes < b)
            here = np.flatnonzero(own | ((sizes >= b) & (sizes * self.threshold < b)))
            if len(here):
                n = sizes[here]
                least = np.maximum(np.ceil(a - 1e-6), np.ceil(self.threshold * n - 1e-9))  # of a partner of this band
                yield number, here, own[here], self.lost(n, np.minimum(least, n))

    def sign(self, s: lk.Sets, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, 64-bit signature, whether as the smaller one, most texts that may have it) of all sets; counts: of the
        features' places, which give the order."""
        often = np.zeros(len(s.features), np.int64) if counts is None else counts[place_of(s.features)]
        order = np.lexsort((s.features, often, s.of))
        of, features, often = s.of[order], s.features[order], often[order]
        begin, size = np.concatenate([[0], np.cumsum(s.sizes)]), s.sizes
        rows, out, small, most = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        for number, here, own, lost in self.bands(size):
            parts = self.parts[number]
            n = size[here]
            t = np.repeat(np.arange(len(here)), n)
            at = begin[here][t] + np.arange(len(t)) - (np.cumsum(n) - n)[t]
            x = features[at]
            group = t * parts + ((x >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            more = nth(group) >= PAIR - 1
            held = np.cumsum(more) - more
            held -= held[np.cumsum(n) - n][t]
            taken = np.flatnonzero(held <= lost[t])
            by = taken[np.argsort(group[taken], kind="stable")]
            t, group, c, x = t[by], group[by], often[at[by]], cp.mix64(x[by] + np.uint64(number + 1))
            place = nth(group)
            for back in range(1, int(place.max(initial=0)) + 1):
                i = np.flatnonzero(place >= back)
                rows.append(here[t[i]])
                out.append(cp.mix64(x[i] + x[i - back]))
                small.append(own[t[i]])
                most.append(np.minimum(c[i], c[i - back]))
        return np.concatenate(rows), np.concatenate(out), np.concatenate(small), np.concatenate(most)


def nth(group: np.ndarray) -> np.ndarray:
    """How many of the same group come before each."""
    order = np.argsort(group, kind="stable")
    g, at = group[order], np.arange(len(group))
    out = np.empty(len(group), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1])[: len(g)], at, 0)) if len(g) else at
    return out


def place_of(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(40)).astype(np.int64) % COUNTS


def feature_counts(rows: DataFrame) -> np.ndarray:
    """How often the features of each place occur in (_key, _features) rows; at most COUNTS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTS, np.int64)
        for b in batches:
            n += np.bincount(place_of(cp.mix64(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").astype(np.uint64))), minlength=COUNTS)
        at = np.flatnonzero(n)
        yield pa.record_batch({"place": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    got = rows.select("_features").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTS, np.int64)
    counts[got["place"].to_numpy()] = got["n"].to_numpy()
    return counts


def entries_of(s: lk.Sets) -> np.ndarray:
    e = np.zeros(len(s.keys), ENTRY)
    e["key"], e["size"], e["sketch"] = s.keys, s.sizes, s.sketches()
    return e


def packed(entries: np.ndarray, rows: np.ndarray, signatures: np.ndarray, small: np.ndarray, salts: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, run, salt, salts, entries, signed) rows. For each bucket one whose run is null: an entry is there once,
    however many of its signatures are. A salted signature has rows of its own: run names it."""
    order = np.argsort(salts, kind="stable") if salts.max(initial=1) > 1 else None
    if order is not None:
        first = int(np.searchsorted(salts[order], 2))
        for k in np.split(order[first:], np.flatnonzero(np.diff(signatures[order[first:]])) + 1) if first < len(order) else []:
            n = int(salts[k[0]])
            salt = (cp.mix64(entries["key"][rows[k]].view(np.uint64)) % np.uint64(n)).astype(np.int64)
            for x in np.unique(salt).tolist():
                mine = k[salt == x]
                signed = np.zeros(len(mine), SIGNED)
                signed["entry"] = np.arange(len(mine)) * 2 + small[mine]
                to = cp.mix64(signatures[k[:1]] + np.uint64(x))[0] % np.uint64(buckets)
                yield int(to), int(signatures[k[0]].astype(np.int64)), x, n, entries[rows[mine]].tobytes(), signed.tobytes()
        cold = np.sort(order[:first])
        rows, signatures, small = rows[cold], signatures[cold], small[cold]
    bucket = (signatures >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket << np.uint64(32) | rows.astype(np.uint64))
    bucket, rows, signatures, small = bucket[order].astype(np.int64), rows[order], signatures[order], small[order]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        fresh = np.append(True, rows[a + 1 : b] != rows[a : b - 1])
        only, number = rows[a:b][fresh], np.cumsum(fresh) - 1
        signed = np.zeros(b - a, SIGNED)
        signed["signature"], signed["entry"] = signatures[a:b] & np.uint64(0xFFFFFFFF), number * 2 + small[a:b]
        yield int(bucket[a]), None, 0, 1, entries[only].tobytes(), signed.tobytes()


def gathered(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries in order of size, a text once, and the distinct signatures as signature << 33 | number of entry << 1 | smaller."""
    entries, signed, n = [np.zeros(0, ENTRY)], [np.zeros(0, np.uint64)], 0
    for e, s in rows:
        e, s = np.frombuffer(e, ENTRY), np.frombuffer(s, SIGNED)
        signed.append((s["signature"].astype(np.uint64) << np.uint64(32)) | (s["entry"].astype(np.uint64) + np.uint64(2 * n)))
        n += len(e)
        entries.append(e)
    e, both = np.concatenate(entries), np.concatenate(signed)
    _, first, number = np.unique(e["key"], return_index=True, return_inverse=True)
    order = np.argsort(e["size"][first], kind="stable")
    place = np.empty(len(first), np.uint64)
    place[order] = np.arange(len(first), dtype=np.uint64)
    low = both & np.uint64(0xFFFFFFFF)
    both = (both >> np.uint64(32) << np.uint64(32)) | ((place[number][(low >> np.uint64(1)).astype(np.int64)] << np.uint64(1)) | (low & np.uint64(1)) if len(e) else low)
    both.sort()
    return e[first][order], both[np.append(True, both[1:] != both[:-1])[: len(both)]]


def pairs_within(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, small: np.ndarray, threshold: float) -> np.ndarray:
    """Distinct close pairs of keys (smaller first) within runs of entries in order of size: of each of the first ``small``
    of a run with all that come after it."""
    found, entries, key, held = [], lk.Entries(e["size"], e["sketch"], threshold), np.ascontiguousarray(e["key"]), [0, 1 << 20]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            x, y = key[i], key[j]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y])
            held[0] += len(i)
            if held[0] > held[1]:
                found[:] = [distinct(found)]
                held[:] = [found[0].shape[1], max(1 << 20, 2 * found[0].shape[1])]

    for a, n, m in zip(*(x[sizes >= LONG].tolist() for x in (starts, sizes, small)), strict=True):
        for i, j in entries.within(a, n, m, TILE):
            keep(i, j)
    starts, sizes, small = (x[sizes < LONG] for x in (starts, sizes, small))
    small = np.minimum(small, sizes - 1)
    at = np.repeat(starts, small) + (np.arange(small.sum()) - np.repeat(np.cumsum(small) - small, small))
    end = np.repeat(starts + sizes, small)
    for back in range(1, LONG):
        alive = at + back < end
        at, end = at[alive], end[alive]
        for a in range(0, len(at), 1 << 15):
            i = at[a : a + (1 << 15)]
            i = i[entries.close(i, entries, i + back)]
            keep(i, i + back)
        if not len(at):
            break
    return distinct(found)


def distinct(found: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    order = np.lexsort(pairs)
    pairs = pairs[:, order]
    return pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(0))[: pairs.shape[1]]]


def _batch(pairs: np.ndarray, blocks: list[tuple] = ()) -> pa.RecordBatch:
    n, m = pairs.shape[1], len(blocks)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = [pa.array([*[None] * n, *[b[k] for b in blocks]], t) for k, t in enumerate(kinds)]
    keys = [pa.concat_arrays([pa.array(p), pa.nulls(m, pa.int64())]) for p in pairs]
    return pa.record_batch([*keys, *columns], ["_a", "_b", "_run", "_i", "_of", "_small", "_block"])


def unseen(keys: np.ndarray, seen: set) -> np.ndarray:
    """A mask of the keys that are not in the set, which takes them in."""
    return np.fromiter((not (k in seen or seen.add(k)) for k in keys.tolist()), bool, len(keys))


def candidates(rows: DataFrame, plan: PartEnum, run: int = RUN, hot: int = HOT) -> DataFrame:
    """Distinct candidate pairs (_a, _b) of text keys of (_key, _features) rows."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    threshold = plan.threshold
    counts = rows.sparkSession.sparkContext.broadcast(feature_counts(rows))  # of COUNTS numbers

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept: list[tuple[np.ndarray, ...]] = []
        names = ["bucket", "run", "salt", "salts", "entries", "signed"]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(k[0]) for k in kept)])
            e, signatures, small, most = (np.concatenate([k[i] for k in kept]) for i in (0, 2, 3, 4))
            row = np.concatenate([k[1] + b for k, b in zip(kept, base, strict=False)])
            kept.clear()
            salts = -(-most // hot)
            by = np.argsort(signatures, kind="stable") if salts.max(initial=1) > 1 else slice(None)
            parts = list(packed(e, row[by], signatures[by], small[by], salts[by], buckets))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), kinds, strict=True)], names)

        for b in batches:
            for x in range(0, b.num_rows, 2000):
                part = b.slice(x, 2000)
                s = lk.Sets.of_rows(part.column(0), part.column(1))
                s.select(unseen(s.keys, seen))
                if len(s.keys):
                    kept.append((entries_of(s), *plan.sign(s, counts.value)))
                if sum(len(k[1]) for k in kept) > 2_000_000:
                    yield flush()
        if kept:
            yield flush()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold: list[tuple[bytes, bytes]] = []
        salted: dict[tuple[int, int, int], list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for r, x, n, e, s in zip(*(b.column(c).to_pylist() for c in ("run", "salt", "salts", "entries", "signed")), strict=True):
                (cold if r is None else salted.setdefault((r, x, n), [])).append((e, s))
        e, both = gathered(cold)
        cold.clear()
        sig, number, own = both >> np.uint64(32), (both >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64), (both & np.uint64(1)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)]), len(sig))
        sizes = np.diff(edges)
        small = np.add.reduceat(own, edges[:-1]) if len(sizes) else sizes
        alone = (sizes > 1) & (small > 0)  # most signatures are of one text
        shared = np.repeat(alone, sizes)
        ordered, names, sizes, small = e[number[shared]], sig[edges[:-1]][alone].tolist(), sizes[alone], small[alone]
        starts = np.cumsum(sizes) - sizes
        few = sizes <= run
        yield _batch(pairs_within(ordered, starts[few], sizes[few], small[few], threshold))
        for k in np.flatnonzero(~few).tolist():
            a, n = int(starts[k]), int(sizes[k])
            of = -(-n // (run // 2))
            for i in range(of):
                one = ordered[a + i * (run // 2) : min(a + (i + 1) * (run // 2), a + n)]
                yield _batch(np.zeros((2, 0), np.int64), [(int(names[k]), i, of, max(0, min(int(small[k]) - i * (run // 2), len(one))), one.tobytes())])
        for (r, x, n), parts in salted.items():
            e, both = gathered(parts)
            own = (both & np.uint64(1)).astype(bool)
            number = (both >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)
            yield _batch(np.zeros((2, 0), np.int64), [(r, x, n, int(own.sum()), e[number].tobytes())])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, x, n, y in zip(*(b.column(c).to_pylist() for c in ("_m", "_left", "_n", "_right")), strict=True):
                left, right = np.frombuffer(x, ENTRY), np.frombuffer(y, ENTRY)
                if x == y:
                    found = [pairs_within(left, *(np.array([v]) for v in (0, len(left), m)), threshold)]
                else:
                    one, two = (lk.Entries(z["size"], z["sketch"], threshold) for z in (left, right))
                    found = []
                    for i, j in one.across(two, m, n, TILE):
                        p, q = left["key"][i], right["key"][j]
                        found.append(np.stack([np.minimum(p, q), np.maximum(p, q)])[:, p != q])
                p = distinct(found)
                yield pa.record_batch({"_a": pa.array(p[0]), "_b": pa.array(p[1])})

    signed = "bucket int, run bigint, salt int, salts int, entries binary, signed binary"
    sent = rows.select("_key", "_features").mapInArrow(sign, signed).repartitionById(buckets, "bucket")
    first = cut(sent.mapInArrow(pair, BLOCKS), "partenum")
    blocks = first.filter("_run is not null").select("_run", "_i", "_of", F.col("_small").alias("_m"), F.col("_block").alias("_left"))
    # a block is written once and meets each block after it
    left = blocks.repartition("_run", "_i").withColumn("_j", F.explode(F.sequence("_i", F.col("_of") - 1)))
    right = blocks.select("_run", F.col("_i").alias("_j"), F.col("_m").alias("_n"), F.col("_left").alias("_right")).repartition("_run", "_j").withColumn("_i", F.explode(F.sequence(F.lit(0), "_j")))
    met = left.join(right.hint("shuffle_hash"), ["_run", "_i", "_j"]).select("_m", "_left", "_n", "_right")
    return first.filter("_run is null").select("_a", "_b").unionByName(met.mapInArrow(across, "_a bigint, _b bigint")).distinct()


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (_a, _b, likeness) of keys of different word multisets whose likeness reaches the threshold."""
    pairs = cut(candidates(rows, PartEnum(threshold)), "partenum-pairs")
    keys = pairs.select(F.col("_a").alias("_key")).unionByName(pairs.select(F.col("_b").alias("_key")))
    return lk.verified(pairs, lk.feature_rows(rows, lk.key_bitmap(keys)), threshold)


def near_duplicates(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(<id>_a, <id>_b) of all pairs of different ids whose texts have a likeness of at least the threshold, smaller id first.

    Texts of fewer than 20 or more than 400 words, null and empty ones take no part; repeated rows count once; rows with
    a null id are left out; an empty table gives an empty one.
    """
    rows = cut(lk.text_rows(df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], "_text"), "partenum-rows")
    members = rows.select("_id", "_key").distinct()
    a, b = members.select(F.col("_id").alias("_x"), F.col("_key").alias("_a")), members.select(F.col("_id").alias("_y"), F.col("_key").alias("_b"))
    different = links(rows, threshold).join(a, "_a").join(b, "_b").select("_x", "_y")
    # of a class of many copies each is dealt to one of its parts, and meets the copies of all parts
    several = members.groupBy("_key").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("_parts"), F.count("*").alias("_n")).filter("_n > 1")
    sized = members.join(several, "_key")
    one = sized.select("_key", F.col("_id").alias("_x"), F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int").alias("_part"))
    other = sized.select("_key", F.col("_id").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    copies = one.join(other, ["_key", "_part"]).filter("_x < _y").select("_x", "_y")
    pair = different.filter("_x <> _y").unionByName(copies)
    return pair.select(F.least("_x", "_y").alias(f"{id_col}_a"), F.greatest("_x", "_y").alias(f"{id_col}_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(_key, _group) of all keys of undirected edges (_a, _b): the least key that can be reached. Alternating large and
    small stars until nothing changes, so the rounds grow with the logarithm of the longest path; each round is written to
    the shared folder, and the one before it deleted."""
    now, was = cut(edges.select("_a", "_b").distinct(), "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
        large = both.join(least, "_a").filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).filter("_a <> _b").distinct()
        down = large.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))
        low = down.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = down.join(low, "_a").select(F.col("_b").alias("_a"), "_m").filter("_a <> _m").unionByName(low.select("_a", "_m")).toDF("_a", "_b").distinct()
        after = cut(small, "stars")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if sums == was:
            break
        was = sums
    groups = now.groupBy("_a").agg(F.min("_b").alias("_group")).withColumnRenamed("_a", "_key")
    roots = now.select(F.col("_b").alias("_key")).distinct().join(groups, "_key", "left_anti").withColumn("_group", F.col("_key"))
    return groups.unionByName(roots)


def near_duplicate_groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, class_id, group_id, class_size, n_links), one row per id and word multiset: texts of one class have equal
    words, classes of one group are linked by likeness, n_links counts the other classes that the class is linked with."""
    rows = cut(lk.text_rows(df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], "_text"), "partenum-rows")
    members = cut(rows.select(F.col("_id").alias(id_col), "_key").distinct(), "partenum-members")
    found = cut(links(rows, threshold).select("_a", "_b"), "partenum-links")
    degree = found.select(F.explode(F.array("_a", "_b")).alias("_key")).groupBy("_key").agg(F.count("*").alias("n_links"))
    size = members.groupBy("_key").agg(F.count("*").alias("class_size"))
    out = members.join(size, "_key").join(components(found), "_key", "left").join(degree, "_key", "left")
    return out.select(F.col(id_col), F.col("_key").alias("class_id"), F.coalesce("_group", "_key").alias("group_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
