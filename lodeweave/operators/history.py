"""Problem 3: full history of changing attributes as a bitemporal ledger.

Every row of the ledger says: from recorded_from to recorded_to it was believed that the version was valid from
valid_from to valid_to. Rows are never overwritten: an update ends the recorded time of the intervals that it changes
and opens new ones. A sweep over the updates of a provision in the order of recording keeps the boundaries of valid
time (starts and repeals) sorted, so that an update touches only the intervals next to the boundaries that it moves;
it streams through a sorted partition and holds one provision's boundaries, never its rows. A provision of more than
HOT_ROWS updates is cut into slices of recorded time; a slice starts from the state that earlier slices lead to (one
pre-aggregated row per version), and intervals that go on across slices are joined again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 50_000
FOREVER = "9999-12-31"
SCHEMA = "provision_id string, slice int, seq int, version string, document_id string, update_id bigint, valid_from date, valid_to date, recorded_from timestamp_ntz, recorded_to timestamp_ntz, carried boolean"


def bare_version(version: Column) -> Column:
    """The number in a version however it is spelled (`v2.1`, `Version 2.1`, ` 2.1 `); null if there is none."""
    return F.nullif(F.regexp_extract(version, r"(\d+(?:\.\d+)*)", 1), F.lit(""))


class Sweep:
    """The boundaries of one provision's valid time and the ledger rows that are open."""

    def __init__(self) -> None:
        self.starts: dict[str, tuple] = {}  # version -> (date, document_id, update_id)
        self.at: dict[object, set[str]] = {}  # date -> versions that start on it
        self.repeals: set = set()
        self.edges: list = []  # sorted dates of starts and repeals
        self.open: dict[str, tuple] = {}  # version -> (document_id, update_id, valid_from, valid_to, recorded_from, carried)

    def _gone(self, date) -> None:
        if date not in self.repeals and not self.at.get(date):
            self.edges.pop(bisect_left(self.edges, date))

    def _new(self, date) -> None:
        i = bisect_left(self.edges, date)
        if i == len(self.edges) or self.edges[i] != date:
            insort(self.edges, date)

    def _before(self, date) -> set[str]:
        i = bisect_left(self.edges, date)
        return self.at.get(self.edges[i - 1], set()) if i else set()

    def apply(self, version: str | None, date, document_id, update_id) -> set[str]:
        """Take in an update (a repeal has no version); the versions whose interval may have changed."""
        if version is None:
            if date in self.repeals:
                return set()
            self.repeals.add(date)
            self._new(date)
            return set(self._before(date))
        touched, old = {version}, self.starts.get(version)
        if old and old[0] != date:
            self.at[old[0]].discard(version)
            self._gone(old[0])
            touched |= self._before(old[0])
        self.starts[version] = (date, document_id, update_id)
        if not old or old[0] != date:
            self.at.setdefault(date, set()).add(version)
            self._new(date)
            touched |= self._before(date)
        return touched

    def settle(self, touched: set[str], recorded, carried: bool, forever) -> Iterator[tuple]:
        """Open the touched versions' new intervals; the ledger rows that end now come out."""
        for v in sorted(touched):
            date, document_id, update_id = self.starts[v]
            i = bisect_right(self.edges, date)
            to = self.edges[i] if i < len(self.edges) else forever
            was = self.open.get(v)
            if was and (was[0], was[2], was[3]) == (document_id, date, to):
                continue
            if was and not (was[4] == recorded and not was[5]):  # of several updates recorded at once the last holds
                yield (v, was[0], was[1], was[2], was[3], was[4], recorded, was[5])
            self.open[v] = (document_id, update_id, date, to, recorded, carried)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import datetime

    forever = datetime.date.fromisoformat(FOREVER)
    kinds = pa.schema([("provision_id", pa.string()), ("slice", pa.int32()), ("seq", pa.int32()), ("version", pa.string()), ("document_id", pa.string()), ("update_id", pa.int64()), ("valid_from", pa.date32()), ("valid_to", pa.date32()), ("recorded_from", pa.timestamp("us")), ("recorded_to", pa.timestamp("us")), ("carried", pa.bool_())])
    key, state, carry, out, seq = None, Sweep(), set(), [], 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        out.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def emit(rows) -> None:
        nonlocal seq
        for r in rows:
            out.append((*key, seq, *r))
            seq += 1

    def finish() -> None:
        if key is not None:
            emit(list(state.settle(carry, None, True, forever)))
            emit([(v, o[0], o[1], o[2], o[3], o[4], None, o[5]) for v, o in sorted(state.open.items())])

    for b in batches:
        for prov, part, is_carry, version, date, document_id, update_id, recorded in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if (prov, part) != key:
                finish()
                key, state, carry, seq = (prov, part), Sweep(), set(), 0
            if is_carry:
                carry |= state.apply(version, date, document_id, update_id)
                continue
            if carry:
                emit(list(state.settle(carry, None, True, forever)))
                carry = set()
            emit(list(state.settle(state.apply(version, date, document_id, update_id), recorded, False, forever)))
        if len(out) >= 20_000:
            yield flush()
    finish()
    yield flush()


def ledger(updates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bitemporal ledger of (provision_id, version, effective_date, action, recorded_at, update_id, document_id) rows:
    provision_id, version, document_id, update_id, valid_from, valid_to, recorded_from, recorded_to (null: still believed).

    Rows without a date, and rows without a version that are no repeal, change nothing; so do exact repeats. Rows of a
    null provision are kept as one provision with a null id. Rows recorded at the same time count in the order of
    update_id. Two versions that start on one day both end on the next later boundary. An empty table gives an empty
    ledger; other columns are left out.
    """
    version = F.when(F.col("action") == "repeal", F.lit(None)).otherwise(bare_version(F.col("version")))
    rows = updates.select("provision_id", version.alias("version"), F.col("effective_date").cast("date").alias("date"), "document_id", F.col("update_id").cast("bigint").alias("update_id"), F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), (F.col("action") == "repeal").alias("_repeal"))
    rows = rows.filter("date is not null and recorded_at is not null and (_repeal or version is not null)").drop("_repeal")
    sizes = rows.groupBy("provision_id").agg(F.count("*").alias("_n"), F.min("recorded_at").alias("_first"), F.max("recorded_at").alias("_last"))
    hot = sizes.filter(F.col("_n") > hot_rows).select(F.col("provision_id").alias("_hot"), F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices"), "_first", "_last")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.floor((us("recorded_at") - us("_first")) / (us("_last") - us("_first") + 1) * F.col("_slices")).cast("int")
    named = rows.join(hot, F.col("provision_id").eqNullSafe(F.col("_hot")), "left").withColumn("slice", F.coalesce(part, F.lit(0)))
    columns = ["provision_id", "slice", "_carry", "version", "date", "document_id", "update_id", "recorded_at"]
    events = named.withColumn("_carry", F.lit(False))

    latest = F.max(F.struct("recorded_at", "update_id", "date", "document_id")).alias("_l")
    ends = events.filter("_slices is not null").groupBy("provision_id", "version", "slice", "_slices", F.when(F.col("version").isNull(), F.col("date")).alias("_day")).agg(latest)
    until = F.coalesce(F.lead("slice").over(W.partitionBy("provision_id", "version", "_day").orderBy("slice")), F.col("_slices") - 1)
    carried = ends.withColumn("_until", until).filter("_until > slice").withColumn("slice", F.explode(F.sequence(F.col("slice") + 1, F.col("_until")))).withColumn("_carry", F.lit(True)).select("provision_id", "slice", "_carry", "version", "_l.date", "_l.document_id", "_l.update_id", "_l.recorded_at")

    def swept(df: DataFrame) -> DataFrame:
        placed = df.select(*columns).repartition("provision_id", "slice").sortWithinPartitions("provision_id", "slice", F.desc("_carry"), "recorded_at", "update_id")
        return placed.mapInArrow(_sweep, SCHEMA)

    keep = ["provision_id", "version", "document_id", "update_id", "valid_from", "valid_to", "recorded_from", "recorded_to"]
    cold = swept(events.filter("_slices is null")).select(*keep)
    pieces = swept(events.filter("_slices is not null").select(*columns).unionByName(carried))
    order = W.partitionBy("provision_id", "version").orderBy("slice", "seq")
    island = F.sum(F.when(F.col("carried"), 0).otherwise(1)).over(order)
    joined = pieces.withColumn("_island", island).groupBy("provision_id", "version", "_island").agg(
        F.min_by(F.struct("document_id", "update_id", "valid_from", "valid_to", "recorded_from"), F.struct("slice", "seq")).alias("_a"),
        F.max_by(F.struct("recorded_to"), F.struct("slice", "seq")).alias("_b"),
    )
    return cold.unionByName(joined.select("provision_id", "version", "_a.document_id", "_a.update_id", "_a.valid_from", "_a.valid_to", "_a.recorded_from", "_b.recorded_to"))


def believed(book: DataFrame, at: str | None = None) -> DataFrame:
    """The ledger's rows as believed at a recorded time (a timestamp string), or now."""
    if at is None:
        return book.filter("recorded_to is null")
    t = F.lit(at).cast("timestamp_ntz")
    return book.filter((F.col("recorded_from") <= t) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > t)))


def current_versions(book: DataFrame, on: str | None = None) -> DataFrame:
    """(provision_id, version, is_current, superseded_by, successor_version) as believed now: is_current on the given day
    (default: without end), the successor is what starts on the day the version ends (the greatest version of several)."""
    now = believed(book)
    nexts = now.groupBy(F.col("provision_id").alias("_p"), F.col("valid_from").alias("_f")).agg(F.max_by(F.struct("document_id", "version"), "version").alias("_next"))
    holds = (F.col("valid_to") == F.lit(FOREVER).cast("date")) if on is None else F.lit(on).cast("date").between(F.col("valid_from"), F.date_sub("valid_to", 1))
    found = now.join(nexts, F.col("provision_id").eqNullSafe(F.col("_p")) & (F.col("valid_to") == F.col("_f")), "left")
    return found.select("provision_id", "version", holds.alias("is_current"), F.col("_next.document_id").alias("superseded_by"), F.col("_next.version").alias("successor_version"))
