"""Problem 5: the most similar vectors of every vector by randomly rotated one-bit codes.

Vectors of unit length are put into cells around centroids, one for CELL vectors, fitted on a bounded sample (of a whole
model, and where that are more than FLAT cells, of each of FIRST coarse cells by a task of its own); every vector is
indexed. What is left of a vector after its cell's centroid is rotated at random and kept as one bit per dimension, with
three scalars: its length, the centroid's inner product and how well the bits point its way. A query's rest is rotated
too and rounded to PLANES bits a dimension; the inner product of bits and query is estimated by counting common bits of
the packed code and of each of the query's bit planes, and corrected by the scalars. Exact cosines are computed of the
few best estimates in the query's own cell, whose k-th best is a lower bound, and then only of vectors whose upper error
bound reaches it. A query takes this bound along to its other PROBES - 1 nearest cells. Of a cell of many vectors or queries
both are cut into blocks, every pair of blocks is a group of bounded work, and the group's hash names its task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import codepoints as cp

K, DIMENSIONS = 5, 64
CELL, SAMPLE, ROUNDS = 1000, 30_000, 8  # vectors in a cell; vectors a fit sees at most, and its rounds
FLAT, FIRST = 2048, 512  # cells fitted at once, at most; coarse cells beyond
MOST_CELLS = 1 << 20  # of all models: their centroids are broadcast (256 MB); beyond, cells hold more than CELL vectors
PROBES, BLOCK, ASKED, EPSILON, PLANES, FEW = 8, 4096, 16_384, 1.9, 4, 3  # FEW: of the best estimates so many times k are reranked first
PART_ROWS = 25_000  # vectors that one partition searches for, on average, at most


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by k-means."""
    rng = np.random.default_rng(5)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[a : a + 8192] @ centres.T).argmax(1) for a in range(0, len(sample), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))
        empty = np.flatnonzero(n == 0)
        sums[empty] = sample[rng.choice(len(sample), len(empty))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def member_type(d: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("code", "<u8", (-(-d // 64),)), ("length", "<f4"), ("fit", "<f4"), ("centre", "<f4"), ("vector", "<f4", (d,))])


def query_type(d: int) -> np.dtype:
    """cell, block: where the query is a member itself; least: the k-th best cosine there."""
    return np.dtype([("id", "<i8"), ("cell", "<i4"), ("block", "<i4"), ("least", "<f4"), ("vector", "<f4", (d,))])


def bits(x: np.ndarray) -> np.ndarray:
    """(rows, words) of 64 packed bits each."""
    return np.packbits(np.pad(x, ((0, 0), (0, -x.shape[1] % 64))), axis=1).view(np.uint64)


def encode(ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes and scalars of vectors, each with its own centroid."""
    out = np.zeros(len(ids), member_type(vectors.shape[1]))
    rest = vectors - centres
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-9)[:, None]) @ turn
    out["id"], out["vector"], out["length"] = ids, vectors, length
    out["code"] = bits(turned >= 0)
    out["fit"] = np.maximum(np.abs(turned).sum(1) / np.sqrt(vectors.shape[1]), 1e-6)
    out["centre"] = (vectors * centres).sum(1)
    return out


GROUP = 8


def kth_bound(x: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each row's k-th largest number: the k-th largest of the maxima of groups of its numbers."""
    n = x.shape[1]
    if n <= k:
        return np.full(len(x), -np.inf, np.float32)
    if n >= GROUP * (k + 1):
        whole = n // GROUP * GROUP
        x = x[:, :whole].reshape(len(x), GROUP, -1).max(1)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def estimates(code: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """Inner products of codes (as 0 and 1) and rounded queries: common bits of every plane, counted."""
    total = np.zeros((len(planes[0]), len(code)), np.uint16)
    for j, plane in enumerate(planes):
        for w in range(code.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.uint16) << np.uint16(j)
    return total


def search(members: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, cosine) of the k best of each query among the members of a block, without itself, as far as they
    reach the query's least cosine; and how many pairs were reranked by their exact cosine."""
    d = len(centre)
    members = members[np.argsort(members["id"])]
    n, code, exact = len(members), np.ascontiguousarray(members["code"]), np.ascontiguousarray(members["vector"])
    share = members["length"] / members["fit"]
    wrong = members["length"] * np.float32(EPSILON / np.sqrt(max(d - 1, 1))) * np.sqrt(np.maximum(1 - members["fit"] ** 2, 0)) / members["fit"]
    right = np.stack([share * np.bitwise_count(code).sum(1), share, members["centre"] - centre @ centre, np.ones(n, np.float32)]).astype(np.float32)
    out, reranked = [], 0
    step = max(1, (1 << 18) // max(n, 1))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        vector = np.ascontiguousarray(q["vector"])
        rest = vector - centre
        away = np.linalg.norm(rest, axis=1).astype(np.float32)
        turned = rest @ turn
        low, high = turned.min(1), turned.max(1)
        width = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-12)
        rounded = np.rint((turned - low[:, None]) / width[:, None]).astype(np.uint8)
        root = np.float32(np.sqrt(d))
        left = np.stack([2 * low / root, -(d * low + width * rounded.sum(1)) / root, np.ones(len(q)), vector @ centre], axis=1).astype(np.float32)
        about = estimates(code, [bits(rounded >> j & 1) for j in range(PLANES)]).astype(np.float32)
        about *= (2 * width / root).astype(np.float32)[:, None]
        about *= share
        about += left @ right
        at = np.searchsorted(members["id"], q["id"])
        own = np.flatnonzero((at < n) & (members["id"][np.minimum(at, n - 1)] == q["id"]))
        about[own, at[own]] = -np.inf

        def cosines(where: np.ndarray, vector: np.ndarray = vector) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j = np.divmod(where, n)
            parts = [np.einsum("ij,ij->i", vector[i[x : x + 4096]], exact[j[x : x + 4096]]) for x in range(0, len(i), 4096)]
            return i, j, np.concatenate(parts) if parts else np.zeros(0, np.float32)

        least, first = q["least"], None
        if not np.isfinite(least).all():
            few = max(1, min(n - 1, FEW * k))
            where = np.flatnonzero((about >= kth_bound(about, few)[:, None]) & np.isfinite(about))
            first = cosines(where)
            reranked += len(where)
            order = np.lexsort((-first[2], first[0]))
            rank = np.arange(len(order)) - np.searchsorted(first[0], first[0])  # the rows of first are in order of their queries
            least = least.copy()
            at_k = order[rank == k - 1]
            np.maximum.at(least, first[0][at_k], first[2][at_k])
            about.ravel()[where] = -np.inf
        about += away[:, None] * wrong
        where = np.flatnonzero((about >= least[:, None]) & np.isfinite(about))
        reranked += len(where)
        i, j, c = cosines(where)
        if first is not None:
            i, j, c = (np.concatenate(x) for x in zip((i, j, c), first, strict=True))
        good = c >= least[i]
        i, j, c = i[good], j[good], c[good]
        order = np.lexsort((members["id"][j], -c, i))
        i, j, c = i[order], j[order], c[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((q["id"][i[best]], members["id"][j[best]], c[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), 0
    return *(np.concatenate(x) for x in zip(*out, strict=True)), reranked


def usable_vectors(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(chunk_id, model, vector): the latest record of every chunk and model, if it has the right number of finite numbers
    that are not all zero. Rows with a null chunk or model are left out; of records of one time the greatest vector counts."""
    time = F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    last = df.filter("chunk_id is not null and embedding_model is not null").groupBy("chunk_id", F.col("embedding_model").alias("model")).agg(F.max_by(F.struct("embedding"), F.struct(time, "embedding")).alias("_l"))
    v = F.col("_l.embedding")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return last.filter(F.size(v) == dimensions).filter(fine).select("chunk_id", "model", v.cast("array<float>").alias("vector"))


def unit(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return (x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)).astype(np.float32)


class Cells:
    """The centroids of all models. Those of a model that has coarse cells are in the order of these."""

    def __init__(self) -> None:
        self.centres: np.ndarray = np.zeros((0, 0), np.float32)
        self.span: dict[str, tuple[int, int]] = {}  # the model's centroids
        self.coarse: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # coarse centroids of a model, and where the cells of each begin and end

    def add(self, model: str, centres: np.ndarray, coarse: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        n = len(self.centres)
        self.centres = np.concatenate([self.centres, centres]) if n else centres
        self.span[model] = (n, n + len(centres))
        if coarse:
            self.coarse[model] = (coarse[0], coarse[1] + n)

    def nearest(self, model: str, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, probes) numbers of the cells of greatest inner product, the first first; -1 beyond the last cell."""
        lo, hi = self.span[model]
        if model not in self.coarse:
            return _top(x @ self.centres[lo:hi].T, probes, lo)
        coarse, edges = self.coarse[model]
        first = _top(x @ coarse.T, probes, 0)
        found, score = np.full((len(x), probes, probes), -1, np.int32), np.full((len(x), probes, probes), -np.inf, np.float32)
        for c in np.unique(first[first >= 0]).tolist():
            row, place = np.nonzero(first == c)
            dots = x[row] @ self.centres[edges[c] : edges[c + 1]].T
            near = _top(dots, probes, 0)
            found[row, place] = np.where(near >= 0, near + edges[c], -1)
            score[row, place] = np.where(near >= 0, np.take_along_axis(dots, np.maximum(near, 0), 1), -np.inf)
        found, score = found.reshape(len(x), -1), score.reshape(len(x), -1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(found, order, 1)


def _top(dots: np.ndarray, probes: int, base: int) -> np.ndarray:
    out = np.full((len(dots), probes), -1, np.int32)
    p = min(probes, dots.shape[1])
    if p and len(dots):
        top = np.argpartition(-dots, p - 1, axis=1)[:, :p]
        out[:, :p] = np.take_along_axis(top, np.argsort(-np.take_along_axis(dots, top, 1), axis=1), 1) + base
    return out


def fit_cells(numbered: DataFrame, sizes: dict[str, int], dimensions: int, sample: int, flat: int) -> Cells:
    """A cell for CELL vectors of each model."""
    cells = Cells()
    most = max(1, MOST_CELLS // max(1, len(sizes)))
    for model, n in sorted(sizes.items()):
        mine = numbered.filter(F.col("model") == model)
        few = mine
        if n > sample:
            few = mine.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(1.1 * sample / n * (1 << 30)))
        seen = unit(few.select("vector").limit(sample).toArrow()["vector"].combine_chunks(), dimensions)
        wanted = max(1, min(most, round(n / CELL)))
        if wanted <= flat:
            cells.add(model, fit(seen, wanted))
            continue
        coarse = fit(seen, min(FIRST, flat))
        share = np.bincount((seen @ coarse.T).argmax(1), minlength=len(coarse)) / len(seen)
        each = np.maximum(1, np.rint(share * wanted)).astype(int)
        # of every coarse cell at most about ``sample`` vectors go to the one task that fits it
        kept = np.minimum(1.0, sample / np.maximum(share * n, 1))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = unit(b.column("vector"), dimensions)
                home = (x @ coarse.T).argmax(1)
                chance = (cp.mix64(b.column("_id").to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(34)).astype(np.float64) / (1 << 30)
                at = np.flatnonzero(chance < kept[home])
                yield pa.record_batch({"cell": pa.array(home[at].astype(np.int32)), "v": pa.array([r.tobytes() for r in x[at]], pa.binary())})

        def sub(t: pa.Table) -> pa.Table:
            c = t["cell"][0].as_py()
            x = np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(-1, dimensions)
            return pa.table({"cell": pa.array([c], pa.int32()), "centres": pa.array([fit(x, int(each[c])).tobytes()], pa.binary())})

        rows = mine.select("_id", "vector").mapInArrow(place, "cell int, v binary").groupBy("cell").applyInArrow(sub, "cell int, centres binary").collect()  # a row per coarse cell
        got = {r["cell"]: np.frombuffer(bytes(r["centres"]), np.float32).reshape(-1, dimensions) for r in rows}
        subs = [got.get(c, coarse[c : c + 1]) for c in range(len(coarse))]
        cells.add(model, np.concatenate(subs), (coarse, np.concatenate([[0], np.cumsum([len(x) for x in subs])])))
    return cells


def counted(column: DataFrame, n: int) -> np.ndarray:
    """How often each of n cells occurs in the column c."""
    out = np.zeros(n, np.int64)
    got = column.groupBy("c").agg(F.count("*").alias("n")).toArrow()
    out[got["c"].to_numpy()] = got["n"].to_numpy()
    return out


def nearest(df: DataFrame, k: int = K, probes: int = PROBES, dimensions: int = DIMENSIONS, sample: int = SAMPLE, flat: int = FLAT) -> DataFrame:
    """(model, chunk_id, neighbour, cosine float, rank int): of each usable vector the k most similar others of its model.

    Input: chunk_id, embedding, embedding_model, created_at; see usable_vectors for the records that count. A model of
    fewer than k + 1 vectors gives fewer rows; equal cosines rank by the vectors' numbers; an empty table gives an empty
    one; other columns are left out. Approximate: a fit of cells sees at most ``sample`` vectors, every vector is indexed,
    and tests hold the recall against brute force above 0.9.
    """
    spark = df.sparkSession
    numbered = cut(usable_vectors(df, dimensions).withColumn("_id", F.monotonically_increasing_id()), "vectors")
    sizes = {r["model"]: r["n"] for r in numbered.groupBy("model").agg(F.count("*").alias("n")).collect()}  # a row per model
    if not sizes:
        return spark.createDataFrame([], "model string, chunk_id string, neighbour string, cosine float, rank int")
    turn = rotation(dimensions)
    fitted = fit_cells(numbered, sizes, dimensions, sample, flat)
    n_cells = len(fitted.centres)
    cells = spark.sparkContext.broadcast(fitted)  # of MOST_CELLS centroids at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column("vector"), dimensions)
            near = np.zeros((len(x), probes), np.int32) - 1
            models = np.array(b.column("model").to_pylist(), object)
            for model in cells.value.span:
                here = np.flatnonzero(models == model)
                if len(here):
                    near[here] = cells.value.nearest(model, x[here], probes)
            yield pa.record_batch({"_id": b.column("_id"), "_unit": pa.array([r.tobytes() for r in x], pa.binary()), "_cells": pa.array([r[r >= 0].tolist() for r in near], pa.list_(pa.int32()))})

    placed = cut(numbered.select("_id", "model", "vector").mapInArrow(place, "_id bigint, _unit binary, _cells array<int>"), "vector-cells")
    # a number per cell each
    held = -(-counted(placed.select(F.col("_cells")[0].alias("c")), n_cells) // BLOCK)
    asked = -(-counted(placed.select(F.explode("_cells").alias("c")), n_cells) // ASKED)
    blocks = spark.sparkContext.broadcast((held, asked))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // PART_ROWS))

    hit = np.dtype([("query", "<i8"), ("vector", "<i8"), ("cosine", "<f4")])
    names = ["part", "cell", "block", "asking", "members", "queries", "hits"]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    dealt = "part int, cell int, block int, asking int, members binary, queries binary, hits binary"

    def part_of(c, s, t) -> np.ndarray:
        key = cp.mix64(cp.mix64(np.array(c, np.uint64) * np.uint64(1 << 20) + np.array(s, np.uint64)) + np.array(t, np.uint64))
        return (key % np.uint64(parts)).astype(np.int32)

    def runs(*keys: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
        """The rows of each combination of keys."""
        order = np.lexsort(keys[::-1])
        change = np.zeros(len(order), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= np.diff(k[order]) != 0
        edges = np.append(np.flatnonzero(change), len(order))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield [int(k[order[a]]) for k in keys], order[a:z]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors to the block that is theirs."""
        held = blocks.value[0]
        for b in batches:
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            home = b.column("_cells").flatten().to_numpy(zero_copy_only=False)[b.column("_cells").offsets.to_numpy(zero_copy_only=False)[:-1] - b.column("_cells").offsets[0].as_py()]
            block = (cp.mix64(ids.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % held[home]
            yield pa.record_batch([pa.array(part_of(home, block, np.zeros(len(ids)))), pa.array(home), pa.array(block.astype(np.int32)), b.column("_id"), b.column("_unit"), b.column("_cells")], ["part", "cell", "block", "_id", "_unit", "_cells"])

    def gathered(h: np.ndarray) -> list[tuple]:
        return [(to[0], -1, -1, -1, b"", b"", h[rows].tobytes()) for to, rows in runs((h["query"] % parts).astype(np.int64))]

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block is searched for its own members; these then go, as members, to the queries that come from elsewhere,
        and as queries, with the least cosine they look for, to the other cells they ask and the other blocks of their own."""
        held, asked = blocks.value
        every = [b for b in batches if b.num_rows]
        if not every:
            return
        table = pa.Table.from_batches(every)
        ids, cell, block = (table[c].to_numpy() for c in ("_id", "cell", "block"))
        x = np.frombuffer(b"".join(table["_unit"].to_pylist()), np.float32).reshape(-1, dimensions)
        column = table["_cells"].combine_chunks()
        ask, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False))
        m = encode(ids, x, cells.value.centres[cell], turn)
        q = np.zeros(len(ids), query_type(dimensions))
        q["id"], q["cell"], q["block"], q["least"], q["vector"] = ids, cell, block, -np.inf, x
        found, out = [], []
        for (c, s), rows in runs(cell, block):
            i, j, cosine, _ = search(m[rows], q[rows], cells.value.centres[c], turn, k)
            h = np.zeros(len(i), hit)
            h["query"], h["vector"], h["cosine"] = i, j, cosine
            found.append(h)
            order = np.argsort(i, kind="stable")  # the hits of a query stay in falling order
            i, cosine = i[order], cosine[order]
            last = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
            by = np.argsort(ids[rows])
            q["least"][rows[by[np.searchsorted(ids[rows], i[last], sorter=by)]]] = cosine[last]
            out += [(c, s, t, m[rows].tobytes(), b"") for t in range(int(asked[c]))]
        owner = np.repeat(np.arange(len(ids)), size)
        group = (cp.mix64(ids.view(np.uint64)) >> np.uint64(1)).astype(np.int64)[owner] % np.maximum(asked[ask], 1)
        other = (ask != cell[owner]) | (held[ask] > 1)
        for (c, t), rows in runs(ask[other], group[other]):
            some = q[owner[other][rows]].tobytes()
            out += [(c, s, t, b"", some) for s in range(int(held[c]))]
        out = [(*r, b"") for r in out]
        part = part_of(*zip(*[r[:3] for r in out], strict=True)).tolist()
        rows = [(p, *r) for p, r in zip(part, out, strict=True)] + gathered(np.concatenate(found))
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, queries, found = defaultdict(list), defaultdict(list), [np.zeros(0, hit)]
        for b in batches:
            for *key, m, q, h in zip(*(b.column(n).to_pylist() for n in names[1:]), strict=True):
                if m:
                    members[tuple(key)].append(np.frombuffer(m, member_type(dimensions)))
                if q:
                    queries[tuple(key)].append(np.frombuffer(q, query_type(dimensions)))
                if h:
                    found.append(np.frombuffer(h, hit))
        for key in list(members):
            mine = members.pop(key)
            if key in queries:
                asking = np.concatenate(queries.pop(key))
                asking = asking[(asking["cell"] != key[0]) | (asking["block"] != key[1])]
                i, j, cosine, _ = search(np.concatenate(mine), asking, cells.value.centres[key[0]], turn, k)
                h = np.zeros(len(i), hit)
                h["query"], h["vector"], h["cosine"] = i, j, cosine
                found.append(h)
        rows = gathered(best_of(np.concatenate(found), k))
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[6] for r in rows], pa.binary())], ["part", "hits"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_ = [np.frombuffer(x, hit) for b in batches for x in b.column("hits").to_pylist()]
        h = best_of(np.concatenate(parts_) if parts_ else np.zeros(0, hit), k)
        rank = np.arange(len(h)) - np.searchsorted(h["query"], h["query"]) + 1
        yield pa.record_batch({"_q": pa.array(h["query"]), "_v": pa.array(h["vector"]), "cosine": pa.array(h["cosine"]), "rank": pa.array(rank.astype(np.int32))})

    sent = placed.mapInArrow(send, "part int, cell int, block int, _id bigint, _unit binary, _cells array<int>").repartitionById(parts, "part")
    asking = sent.mapInArrow(at_home, dealt).repartitionById(parts, "part")
    found = asking.mapInArrow(elsewhere, "part int, hits binary").repartitionById(parts, "part").mapInArrow(best, "_q bigint, _v bigint, cosine float, rank int")
    chunk = numbered.select("_id", "model", "chunk_id")
    out = found.join(chunk.withColumnRenamed("_id", "_q"), "_q").join(chunk.select(F.col("_id").alias("_v"), F.col("chunk_id").alias("neighbour")), "_v")
    return out.select("model", "chunk_id", "neighbour", "cosine", "rank")


def best_of(h: np.ndarray, k: int) -> np.ndarray:
    """The k hits of greatest cosine of each query, in order; a vector counts once."""
    h = h[np.lexsort((h["vector"], -h["cosine"], h["query"]))]
    return h[np.arange(len(h)) - np.searchsorted(h["query"], h["query"]) < k]


def similar_pairs(neighbours: DataFrame, least: float = 0.90) -> DataFrame:
    """(chunk_id_a, chunk_id_b) of the pairs in which one is a neighbour of the other with at least the given cosine."""
    near = neighbours.filter(F.col("cosine") >= F.lit(least).cast("float"))
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()
