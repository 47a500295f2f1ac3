"""Problem 7: fixed-capacity containers filled with texts by linear grouping.

The sizes of all pieces are counted into one histogram (at most ``capacity`` rows, whatever the data). Large sizes are
cut into groups of equal cardinality and rounded up to the largest of their group; for these few sizes the fractional
optimum over configurations is found by column generation, and its whole part is used. Actual pieces then take the
slots of their group by a distributed rank, and the small pieces, with the few large ones beyond the whole part, go
best-fit into what is left, in shards of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

GROUPS = 24
SHARD_ROWS = 60_000  # pieces and open containers that one best-fit task holds


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each: how many pieces of every size) and how often each is used, by column generation over a knapsack."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            gain = np.where(sizes <= c, best[np.maximum(c - sizes, 0)] + price, -1.0)
            k = int(gain.argmax())
            best[c], last[c] = (gain[k], k) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(len(sizes)), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= int(sizes[last[c]])
        x, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return basis.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand), 0)


class Plan:
    """Groups of large sizes, and for every group the containers whose slots its pieces take in turn."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, small: int):
        large = sorted((s for s in histogram if s > small), reverse=True)
        total, self.group = sum(histogram[s] for s in large), np.full(capacity + 1, -1, np.int32)
        tops: list[int] = []
        demand: list[int] = []
        for s in large:
            if not tops or demand[-1] >= total / groups:
                tops.append(s)
                demand.append(0)
            demand[-1] += histogram[s]
            self.group[s] = len(tops) - 1
        self.containers, self.slots = 0, [[] for _ in tops]  # of each group: (first rank, containers, slots in each, first container)
        taken = [0] * len(tops)
        if tops:
            patterns, times = configurations(np.array(tops), np.array(demand, float), capacity)
            for p, x in zip(patterns.T.tolist(), np.floor(times + 1e-9).astype(int).tolist(), strict=True):
                if x and any(p):
                    for g, a in enumerate(p):
                        if a:
                            self.slots[g].append((taken[g], x, a, self.containers))
                            taken[g] += x * a
                    self.containers += x
        self.rest = sum(n for s, n in histogram.items() if s <= small) + sum(max(0, d - t) for d, t in zip(demand, taken, strict=True))

    def place(self, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Container of the rank-th piece of a group; -1 beyond the slots."""
        out = np.full(len(group), -1, np.int64)
        for g, slots in enumerate(self.slots):
            here = np.flatnonzero(group == g)
            if not len(here) or not slots:
                continue
            first, x, a, base = (np.array(v) for v in zip(*slots, strict=True))
            k = np.searchsorted(first, rank[here], "right") - 1
            off = rank[here] - first[k]
            out[here] = np.where(off < x[k] * a[k], base[k] + off % x[k], -1)
        return out


def best_fit(free: list[int], sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """For each size, in falling order of size, the place it goes: an index of free, or beyond them a new container. And how many are new."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, f in enumerate(free):
        stacks[f].append(k)
        mask |= 1 << f
    out, opened = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        fits = mask >> sizes[i]
        if fits:
            f = sizes[i] + (fits & -fits).bit_length() - 1
            k = stacks[f].pop()
            if not stacks[f]:
                mask &= ~(1 << f)
        else:
            f, k = capacity, len(free) + opened
            opened += 1
        out[i] = k
        stacks[f - sizes[i]].append(k)
        mask |= 1 << (f - sizes[i])
    return out, opened


def pack(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048, groups: int = GROUPS, small: int | None = None) -> DataFrame:
    """Containers of at most ``capacity``: (container_id bigint, id_col, seg_no int, start bigint, size int), one row per piece.

    A size over the capacity is split into whole containers and one rest (seg_no 0, 1, ...); no other is split. Null and
    non-positive sizes hold nothing: one row with a null container_id and size 0. Repeated rows are packed each by itself,
    a null id is an id like others, an empty table gives an empty one, other columns are left out.
    The plan depends on the histogram alone; ``small`` (default an eighth of the capacity) divides large from small.
    """
    small = capacity // 8 if small is None else small
    spark = df.sparkSession
    n = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    pieces = df.select(F.col(id_col).alias("_id"), F.greatest(n, F.lit(0)).alias("_n"))
    pieces = pieces.select("_id", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0)))).alias("_seg"))
    pieces = cut(pieces.select("_id", "_seg", F.least(F.lit(capacity), F.col("_n") - F.col("_seg") * capacity).cast("int").alias("_size")), "pack-pieces")
    # at most capacity + 1 rows, whatever the data
    plan = Plan({r[0]: r[1] for r in pieces.filter("_size > 0").groupBy("_size").count().collect()}, capacity, groups, small)
    id_type = pieces.schema["_id"].dataType

    @F.arrow_udf("int")
    def group_of(size: pa.Array) -> pa.Array:
        return pa.array(plan.group[size.to_numpy(zero_copy_only=False)])

    @F.arrow_udf("bigint")
    def container_of(group: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.array(plan.place(group.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)))

    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = pieces.filter("_size > 0").withColumn("_group", group_of("_size")).withColumn("_salt", F.pmod(F.xxhash64("_id", "_seg"), F.lit(salts)))
    large = filled.filter("_group >= 0")
    before = W.partitionBy("_group").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    # salts x groups rows: a small, bounded table
    offsets = large.groupBy("_group", "_salt").agg(F.count("*").alias("_c")).select("_group", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    ranked = large.withColumn("_rn", F.row_number().over(W.partitionBy("_salt", "_group").orderBy("_id", "_seg"))).join(F.broadcast(offsets), ["_group", "_salt"])
    placed = cut(ranked.select("_id", "_seg", "_size", container_of("_group", F.col("_off") + F.col("_rn") - 1).alias("_container")), "pack-placed")
    done = placed.filter("_container >= 0")
    rest = filled.filter("_group < 0").select("_id", "_seg", "_size").unionByName(placed.filter("_container < 0").drop("_container"))
    shards = max(1, math.ceil((plan.rest + plan.containers) / SHARD_ROWS))
    room = done.groupBy("_container").agg((capacity - F.sum("_size")).cast("int").alias("_size")).filter("_size > 0")
    open_rows = room.select(F.pmod(F.xxhash64("_container"), F.lit(shards)).cast("int").alias("_shard"), "_container", F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("int").alias("_seg"), "_size")
    item_rows = rest.select(F.pmod(F.xxhash64("_id", "_seg"), F.lit(shards)).cast("int").alias("_shard"), F.lit(None).cast("bigint").alias("_container"), "_id", "_seg", "_size")
    base = plan.containers

    def fill(t: pa.Table) -> pa.Table:
        is_open = np.asarray(t["_seg"].is_null())
        items, opens = t.filter(pa.array(~is_open)), t.filter(pa.array(is_open))
        ids = opens["_container"].to_pylist()
        where, new = best_fit(opens["_size"].to_pylist(), items["_size"].to_pylist(), capacity)
        ids += [base + t["_shard"][0].as_py() + shards * k for k in range(new)]
        return pa.table({"_id": items["_id"], "_seg": items["_seg"], "_size": items["_size"], "_container": pa.array([ids[k] for k in where], pa.int64())})

    late = open_rows.unionByName(item_rows).groupBy("_shard").applyInArrow(fill, placed.select("_id", "_seg", "_size", "_container").schema)
    nothing = pieces.filter("_size <= 0").select("_id", "_seg", F.lit(0).alias("_size"), F.lit(None).cast("bigint").alias("_container"))
    every = done.unionByName(late).unionByName(nothing)
    return every.select(F.col("_container").alias("container_id"), F.col("_id").alias(id_col), F.col("_seg").alias("seg_no"), (F.col("_seg").cast("bigint") * capacity).alias("start"), F.col("_size").alias("size"))
