"""Exact vector search of a stated set of queries against all vectors, in blocks.

Vectors are dealt out to parts and queries to blocks of bounded size; every (part, block) pair is one group, whose
inner products are matrix products of tiles. Parts and blocks are as large as memory allows, as every vector is sent once per
block, every query once per part, and every part has hits of its own. A group emits its k best per query, or all pairs above a threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import top

GROUP_BYTES = 1 << 25  # of the vectors of a part and of the queries of a block, each in double precision
TILE_ROWS, TILE_COLUMNS = 1_024, 4_096  # queries and vectors of one product


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def scores(queries: DataFrame, vectors: DataFrame, query_id: str = "query_id", id_col: str = "id", vector_col: str = "embedding", k: int | None = None, above: float | None = None) -> DataFrame:
    """(query_id, id, score): cosines of six decimals; of each query the k best of every part, or all strictly above a
    threshold. Vectors must have one length; null vectors are left out, a vector of length 0 has cosine 0 to all."""
    q, v = queries.filter(F.col(vector_col).isNotNull()), vectors.filter(F.col(vector_col).isNotNull())
    stored, length = v.agg(F.count("*"), F.coalesce(F.max(F.size(vector_col)), F.lit(1))).first()
    rows = max(1, GROUP_BYTES // (8 * max(1, length)))
    parts, blocks = max(1, math.ceil(stored / rows)), max(1, math.ceil(q.count() / rows))
    left = q.select(F.col(query_id).alias("_q"), F.col(vector_col).alias("_v"), F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    right = v.select(F.col(id_col).alias("_i"), F.col(vector_col).alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_block"))
    kinds = (queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString())

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i = j = np.zeros(0, np.int64)
            s = np.zeros(0)
        else:
            b = b.take(pc.sort_indices(b["_i"]))  # places are in the order of ids, so that ties go to the lower place
            x, y = _matrix(a["_v"]), _matrix(b["_v"])
            i, j, s = map(np.concatenate, zip(*(_chosen(x, y, at, k, above) for at in range(0, len(x), TILE_ROWS)), strict=True))
        return pa.table({"query_id": a["_q"].take(pa.array(i)), "id": b["_i"].take(pa.array(j)), "score": pa.array(s, pa.float64())})

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(product, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _chosen(x: np.ndarray, y: np.ndarray, at: int, k: int | None, above: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the queries x[at : at + TILE_ROWS]. Products of single precision say which pairs can matter,
    and only theirs are taken in double precision."""
    mine = x[at : at + TILE_ROWS]
    few = mine.astype(np.float32)
    slack = 4e-7 * (x.shape[1] + 8) + 1e-6  # what single precision and rounding may change, with a margin
    least = np.full(len(mine), -np.inf if above is None else above)  # scores beyond it count
    i, j, s, parts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), []
    for start in range(0, len(y), TILE_COLUMNS):
        tile = y[start : start + TILE_COLUMNS]
        m = few @ tile.astype(np.float32).T
        reach = least
        if above is None and not start and k < m.shape[1]:
            reach = np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k] - slack
        p, q = np.nonzero(m >= (reach - slack).astype(np.float32)[:, None])
        if len(p) * 20 > m.size:
            t = (mine @ tile.T)[p, q]
        else:
            step = max(1, (1 << 22) // x.shape[1])
            t = np.concatenate([np.einsum("ij,ij->i", mine[p[c : c + step]], tile[q[c : c + step]]) for c in range(0, max(1, len(p)), step)])
        t = np.round(t, 6)
        new = t > least[p]
        p, q, t = p[new], q[new] + start, t[new]
        if above is not None:
            parts.append((p, q, t))
        elif len(p):
            i, j, s = np.concatenate([i, p]), np.concatenate([j, q]), np.concatenate([s, t])
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            least[i[nth == k - 1]] = s[nth == k - 1]
            i, j, s = i[nth < k], j[nth < k], s[nth < k]
    if parts:
        i, j, s = map(np.concatenate, zip(*parts, strict=True))
    return i + at, j, s


def scores_within(vectors: DataFrame, group: list[str], above: float, order_col: str, id_col: str = "id", vector_col: str = "embedding", block: int = 4_000) -> DataFrame:
    """(later, earlier) ids of pairs within a group whose cosine (of six decimals) is greater, the later one by order, then id.
    Only vectors of one group meet. A group is cut into blocks of about ``block`` vectors, each pair of blocks is a task's
    matrix product, and a block is sent to the pairs it is in."""
    v = vectors.filter(F.col(vector_col).isNotNull()).select(*group, F.col(id_col).alias("_i"), F.col(order_col).alias("_o"), F.col(vector_col).alias("_v"))
    sizes = v.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    dealt = v.join(sizes, group).withColumn("_p", F.pmod(F.xxhash64("_i"), F.col("_parts")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda x: F.struct(F.least("_p", x).alias("a"), F.greatest("_p", x).alias("b"))))
    rows = dealt.withColumn("_m", met).select(*group, "_m.a", "_m.b", "_p", "_i", "_o", "_v")
    kind = vectors.schema[id_col].dataType.simpleString()

    def product(t: pa.Table) -> pa.Table:
        a, b = t["a"][0].as_py(), t["b"][0].as_py()
        part = t["_p"].to_numpy()
        left, right = t.filter(pa.array(part == a)), t.filter(pa.array(part == b))
        m = np.round(_matrix(left["_v"]) @ _matrix(right["_v"]).T, 6)
        i, j = np.nonzero(m > above)
        keys = [list(zip(x["_o"].to_pylist(), x["_i"].to_pylist(), strict=True)) for x in (left, right)]
        pairs = {tuple(sorted((keys[0][x], keys[1][y]), key=lambda k: (k[0] is not None, k))) for x, y in zip(i.tolist(), j.tolist(), strict=True) if keys[0][x] != keys[1][y]} if len(i) else set()
        return pa.table({"later": pa.array([p[1][1] for p in pairs], t.schema.field("_i").type), "earlier": pa.array([p[0][1] for p in pairs], t.schema.field("_i").type)})

    return rows.groupBy(*group, "a", "b").applyInArrow(product, f"later {kind}, earlier {kind}")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, query_id: str = "query_id", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors of each query by cosine; ties by id."""
    return top(scores(queries, vectors, query_id, id_col, vector_col, k=k), "query_id", "id", k)
