"""Problem 4: new batches deduplicated against all history by a prefix-tree hash forest.

A tree orders all texts by a label: a sequence of min-hash values of the text's word multiset, of hash functions that are
the tree's own, so that trees miss a text independently of each other. Texts share a label's first d values with the
chance likeness ** d, so the texts that agree longest are the likeliest. A forest is kept in a folder: sorted runs of
labels in a table bucketed by the labels' first values, the word features of the accepted texts, and a small file for each
version that names them; any session can open it. A batch is signed once and sent to the buckets (only the batch moves),
its labels are located in the runs by range search, and the prefix that must agree is widened, value by value, until the
recall target holds: at depth d and TREES trees a text of the threshold's likeness is met with the chance
1 - (1 - threshold ** d) ** TREES. A text whose very copy is met needs no wider search. What sizes and sketches don't rule
out is verified exactly. What a batch adds becomes a run of its own, and after some runs all are merged into one. A prefix
that many texts have is dealt to several buckets, so that none holds all of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, release, shared_dir
from . import codepoints as cp
from . import likeness as lk
from .neardup import BUCKET_ROWS, components, distinct, pairs_within, unseen

THRESHOLD, TREES, RECALL = 0.70, 37, 0.99
DEEPER = 3  # values of a label beyond the widest prefix
MERGE_AFTER, MERGE_SHARE = 48, 0.5  # runs, or the share of texts that came since the last merge, after which all are merged
PLACES, HOT = 1 << 20, 200_000  # places of the counts of prefixes; labels of one place in one bucket, about, at most
TOGETHER = 0.1  # share of the history up to which waiting batches are searched in one pass
FEW_PAIRS = 200_000  # candidates of a batch that are broadcast
ROUNDS, COMPONENT = 6, 500_000  # of decisions before components are looked for; links of a component that one task decides
ENTRY = np.dtype([("key", "<i8"), ("size", "<u2"), ("sketch", "<u8", (2,))])
SIGNED = np.dtype([("label", "<u8"), ("entry", "<u4")])
ROWS = "_key bigint, _n int, _features binary"
PACKED = "bucket int, entries binary, labels binary"


def widest_depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which the recall target still holds."""
    d = 1
    while 1 - (1 - threshold ** (d + 1)) ** trees >= recall:
        d += 1
    return d


class Labels:
    """Labels of texts in every tree: 40 bits of the widest prefix, then 8 bits of each of DEEPER more values."""

    def __init__(self, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL):
        self.threshold, self.depth = threshold, widest_depth(threshold, trees, recall)
        # values up to the widest prefix are of one tree alone; those beyond it only order the search and are shared
        own, rng = trees * self.depth, np.random.default_rng(4)
        self.factors = rng.integers(1, 1 << 63, own, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        deeper = np.array([rng.permutation(own)[:DEEPER] for _ in range(trees)])
        self.trees = np.concatenate([np.arange(own).reshape(trees, self.depth), deeper], axis=1)

    def of(self, s: lk.Sets) -> np.ndarray:
        """(texts, trees) uint64."""
        starts = np.concatenate([[0], np.cumsum(s.sizes)[:-1]]).astype(np.int64)
        least = np.empty((len(s.keys), len(self.factors)), np.uint64)
        for m, a in enumerate(self.factors):
            x = s.features * a
            least[:, m] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
        least = cp.mix64(least)
        label = np.full((len(s.keys), len(self.trees)), np.uint64(1)) * (np.arange(len(self.trees), dtype=np.uint64) + np.uint64(1))
        for j in range(self.depth):
            label = label * np.uint64(0x9FB21C651E98DF25) + least[:, self.trees[:, j]]
        label = cp.mix64(label) & np.uint64(0xFFFFFFFFFF000000)
        for j in range(DEEPER):
            label |= (least[:, self.trees[:, self.depth + j]] >> np.uint64(56)) << np.uint64(8 * (DEEPER - 1 - j))
        return label


def bucket_ids(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions a number that falls into it (n rows reach the driver)."""
    rows = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    got = {r["p"]: r["id"] for r in rows}
    return [got.get(p, rows[0]["id"]) for p in range(n)]


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half the bits, whose differing bits are still never more than the differing features."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def dealt(e: np.ndarray, labels: np.ndarray, ids: np.ndarray, hot: np.ndarray | None, everywhere: bool) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(bucket, entries, sorted labels, first) rows of (texts, trees) labels. hot: how many buckets a place's labels are dealt
    to; a text is in one of them, or in all if ``everywhere``, and first in one."""
    row, flat = np.repeat(np.arange(len(e)), labels.shape[1]), labels.ravel()
    first = np.ones(len(flat), bool)
    salt = np.zeros(len(flat), np.uint64)
    if hot is not None:
        salts = hot[(flat >> np.uint64(44)).astype(np.int64)]
        if everywhere:
            again = np.repeat(np.arange(len(flat)), salts)
            salt = (np.arange(len(again)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.uint64)
            row, flat, first = row[again], flat[again], salt == 0
        else:
            salt = cp.mix64(e["key"][row].view(np.uint64)) % salts.astype(np.uint64)
    bucket = (cp.mix64((flat >> np.uint64(24)) + salt * np.uint64(0x9FB21C651E98DF25)) % np.uint64(len(ids))).astype(np.int64)
    order = np.lexsort((flat, row, first, bucket))
    bucket, row, flat, first = bucket[order], row[order], flat[order], first[order]
    edges = np.append(np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (first[1:] != first[:-1]))[: len(bucket)]), len(bucket))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        only, number = np.unique(row[a:b], return_inverse=True)
        s = np.zeros(b - a, SIGNED)
        s["label"], s["entry"] = flat[a:b], number
        yield int(ids[bucket[a]]), e[only].tobytes(), np.sort(s, order="label").tobytes(), bool(first[a])


class HashForest:
    """The sorted runs of all accepted texts, in a folder. ``create`` and ``open`` give one; ``search``, ``accept`` and
    ``merge`` use it. Every change is a new version, a file of its own, that another writer can't take as well."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.labels = Labels(state["threshold"], state["trees"], state["recall"])
        self._ids: dict[int, np.ndarray] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, rows: int = 0) -> HashForest:
        """An empty forest. ``rows``: about how many texts it will hold, for the number of buckets; merging adapts it."""
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        state = {"threshold": threshold, "trees": trees, "recall": recall, "buckets": buckets, "labels": f"labels_{uuid.uuid4().hex}", "rows": [], "hot": [], "texts": 0, "counted": 0, "merged": 0, "runs": 0, "version": 0}
        out = cls(spark, path, state)
        out._commit()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashForest:
        """The last version of the forest of a folder."""
        fs, hadoop = _files(spark, path)
        versions = sorted(s.getPath().getName() for s in fs.listStatus(hadoop(f"{path.rstrip('/')}/versions")))
        text = spark.read.text(f"{path.rstrip('/')}/versions/{versions[-1]}", wholetext=True).first()[0]
        return cls(spark, path, json.loads(text))

    def _commit(self) -> None:
        self.state["version"] += 1
        fs, hadoop = _files(self.spark, self.path)
        out = fs.create(hadoop(f"{self.path}/versions/{self.state['version']:012d}.json"), False)  # an error if it is there
        out.write(json.dumps(self.state).encode())
        out.close()

    @property
    def runs(self) -> int:
        return self.state["runs"]

    def _table(self) -> DataFrame:
        name = self.state["labels"]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PACKED}) USING parquet CLUSTERED BY (bucket) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _buckets(self) -> np.ndarray:
        n = self.state["buckets"]
        if n not in self._ids:
            self._ids[n] = np.array(bucket_ids(self.spark, n))
        return self._ids[n]

    def _hot(self) -> np.ndarray | None:
        if not self.state["hot"]:
            return None
        out = np.ones(PLACES, np.int64)
        for place, salts in self.state["hot"]:
            out[place] = salts
        return out

    def signed(self, rows: DataFrame) -> DataFrame:
        """Rows (_key, _n, _features and others) with their labels and folded sketches, _labels and _sketch: what signing
        costs is spent here, and once if the result is written."""
        labels = self.labels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in range(0, b.num_rows, 2000):
                    part = b.slice(x, 2000)
                    s = lk.Sets.of_rows(part.column(0), part.column(2))
                    sketch, label = folded(s.sketches()), labels.of(s)
                    at = {k: i for i, k in enumerate(s.keys.tolist())}
                    where = [at[k] for k in part.column(0).to_pylist()]
                    yield pa.record_batch([*part.columns, pa.array([label[i].tobytes() for i in where], pa.binary()), pa.array([sketch[i].tobytes() for i in where], pa.binary())], [*part.schema.names, "_labels", "_sketch"])

        first = ["_key", "_n", "_features"]
        rows = rows.select(*first, *[c for c in rows.columns if c not in first])
        kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(run, f"{kinds}, _labels binary, _sketch binary")

    def _packed(self, signed: DataFrame, everywhere: bool) -> DataFrame:
        """(bucket, entries, labels, first) rows; a task packs each key once."""
        ids, hot, trees = self._buckets(), self._hot(), self.state["trees"]
        shared = self.spark.sparkContext.broadcast((ids, hot))  # a number per bucket, and PLACES numbers at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, hot = shared.value
            seen: set[int] = set()
            kept: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> pa.RecordBatch:
                e, label = (np.concatenate(x) for x in zip(*kept, strict=True))
                kept.clear()
                out = list(dealt(e, label, ids, hot, everywhere))
                return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["bucket", "entries", "labels", "first"])

            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                fresh = np.flatnonzero(unseen(keys, seen))
                if len(fresh):
                    take = pa.array(fresh)
                    e = np.zeros(len(fresh), ENTRY)
                    e["key"], e["size"] = keys[fresh], b.column(1).to_numpy(zero_copy_only=False)[fresh]
                    e["sketch"] = np.frombuffer(b"".join(b.column(3).take(take).to_pylist()), np.uint64).reshape(len(e), -1)
                    kept.append((e, np.frombuffer(b"".join(b.column(2).take(take).to_pylist()), np.uint64).reshape(len(e), trees)))
                if sum(len(k[0]) for k in kept) > 60_000:
                    yield flush()
            if kept:
                yield flush()

        return signed.select("_key", "_n", "_labels", "_sketch").mapInArrow(run, f"{PACKED}, first boolean")

    def accept(self, rows: DataFrame) -> None:
        """Append texts, signed or not, as a run of their own; merge where there are many runs or prefixes became hot."""
        at = f"rows_{uuid.uuid4().hex}"
        rows.select("_key", "_n", "_features").write.option("compression", "zstd").parquet(f"{self.path}/{at}")
        signed = rows if "_labels" in rows.columns else self.signed(self.spark.read.schema(ROWS).parquet(f"{self.path}/{at}"))
        self._write(self._packed(signed, False).drop("first"))
        added = self.spark.read.schema(ROWS).parquet(f"{self.path}/{at}").count()
        self.state["rows"].append(at)
        self.state["texts"] += added
        self.state["runs"] += 1
        self._commit()
        late = self.state["texts"] - self.state["merged"]
        if self.state["runs"] > MERGE_AFTER or (self.state["merged"] and late > MERGE_SHARE * self.state["merged"]) or (self.state["texts"] > 2 * self.state["counted"] and self._recount()):
            self.merge()
        elif not self.state["merged"]:
            self.state["merged"] = self.state["texts"]
        release(self.spark)

    def _write(self, packed: DataFrame) -> None:
        self._table()
        n = self.state["buckets"]
        packed.repartition(n, "bucket").write.option("compression", "lz4").bucketBy(n, "bucket").option("path", f"{self.path}/{self.state['labels']}").mode("append").saveAsTable(self.state["labels"])

    def _recount(self) -> bool:
        """Count the labels by place; whether a place needs more buckets than it is dealt to."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(PLACES, np.int64)
            for b in batches:
                for s in b.column(0).to_pylist():
                    n += np.bincount((np.frombuffer(s, SIGNED)["label"] >> np.uint64(44)).astype(np.int64), minlength=PLACES)
            at = np.flatnonzero(n)
            yield pa.record_batch({"place": pa.array(at, pa.int32()), "n": pa.array(n[at])})

        got = self._table().select("labels").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).collect()  # at most PLACES rows
        had = dict(self.state["hot"])
        self.state["hot"] = sorted([r["place"], -(-r["n"] // HOT)] for r in got)
        self.state["counted"] = self.state["texts"]
        return any(had.get(p, 1) < n for p, n in self.state["hot"])

    def merge(self) -> None:
        """Merge all runs into one, in as many buckets as the texts need, and deal hot prefixes out."""
        old, gone = self._table(), self.state["labels"]
        self._recount()
        self.state["labels"] = f"labels_{uuid.uuid4().hex}"
        self.state["buckets"] = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.state["texts"] // BUCKET_ROWS))
        ids, hot = self._buckets(), self._hot()

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for e, s in zip(b.column("entries").to_pylist(), b.column("labels").to_pylist(), strict=True):
                    e, s = np.frombuffer(e, ENTRY), np.frombuffer(s, SIGNED)
                    out += [r[:3] for r in dealt(e[s["entry"]], s["label"][:, None], ids, hot, False)]
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "entries", "labels"])

        def one(t: pa.Table) -> pa.Table:
            e, s = merged(t)
            return pa.table({"bucket": t["bucket"].slice(0, 1), "entries": pa.array([e.tobytes()], pa.binary()), "labels": pa.array([s.tobytes()], pa.binary())})

        self._write(old.mapInArrow(again, PACKED).groupBy("bucket").applyInArrow(one, PACKED))
        self.state["runs"], self.state["merged"] = (1 if self.state["runs"] else 0), self.state["texts"]
        self._commit()
        self.spark.sql(f"DROP TABLE {gone}")  # its files stay where a late reader may need them

    def candidates(self, signed: DataFrame) -> DataFrame:
        """Pairs (_a of the batch, _b, _stored) that may be alike: with the accepted texts, and within the batch."""
        threshold = self.labels.threshold

        def look(stored: pa.Table, new: pa.Table) -> pa.Table:
            if not new.num_rows:
                return pa.table({"_a": pa.array([], pa.int64()), "_b": pa.array([], pa.int64()), "_stored": pa.array([], pa.bool_())})
            e, s = merged(new)
            mine = lk.Entries(e["size"], e["sketch"], threshold)
            found, own = [], np.ascontiguousarray(e["key"])
            for old, runs in zip(stored["entries"].to_pylist(), stored["labels"].to_pylist(), strict=True):
                found += located(np.frombuffer(old, ENTRY), np.frombuffer(runs, SIGNED), own, mine, s, threshold)
            against = distinct(found)
            e, s = merged(new.filter(new["first"]))
            prefix = s["label"] >> np.uint64(8 * DEEPER)
            edges = np.append(np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)]), len(prefix))
            sizes = np.diff(edges)
            order = np.lexsort((e["size"][s["entry"]], prefix))
            several = sizes > 1
            within = pairs_within(e[s["entry"][order]], edges[:-1][several], sizes[several], sizes[several], threshold)
            return pa.table({"_a": pa.array(np.concatenate([against[0], within[0]])), "_b": pa.array(np.concatenate([against[1], within[1]])), "_stored": pa.array(np.arange(against.shape[1] + within.shape[1]) < against.shape[1])})

        batch = self._packed(signed, True)
        return self._table().groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInArrow(look, "_a bigint, _b bigint, _stored boolean").distinct()

    def search(self, signed: DataFrame) -> DataFrame:
        """Pairs (_a of the batch, _b, _stored) whose likeness reaches the threshold, equal texts among them (_a = _b) if stored.
        Signed rows should be written (``cut``), as they are read twice; the texts of the history
        aren't read, and of its features only what candidates need is kept."""
        pairs = cut(self.candidates(signed), "forest-pairs")
        apart, mine = pairs.filter("_a <> _b"), signed.select("_key", "_n", "_features")
        if pairs.count() <= FEW_PAIRS:  # of 17 bytes
            feature = lambda x: [F.col("_key").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_features").alias(f"_f{x}")]
            theirs = self.accepted().unionByName(mine).select(*feature("b"))
            both = theirs.join(F.broadcast(apart), "_b").dropDuplicates(["_a", "_b", "_stored"]).join(mine.select(*feature("a")), "_a")
            links = lk.likeness_of(both).filter(F.col("likeness") >= self.labels.threshold)
        else:
            bitmap = lk.key_bitmap(apart.select(F.explode(F.array("_a", "_b")).alias("_key")))
            features = lk.feature_rows(self.accepted().unionByName(mine), bitmap)
            links = lk.verified(apart.select("_a", "_b").distinct(), features, self.labels.threshold).select("_a", "_b").join(apart, ["_a", "_b"])
        out = cut(links.select("_a", "_b", "_stored").unionByName(pairs.filter("_a = _b and _stored")).distinct(), "forest-links")
        discard(pairs)
        return out

    def accepted(self) -> DataFrame:
        """(_key, _n, _features) of the accepted texts."""
        if not self.state["rows"]:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/{r}" for r in self.state["rows"]])


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def located(old: np.ndarray, runs: np.ndarray, own: np.ndarray, mine: lk.Entries, s: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Pairs (key of the batch, stored key) that sizes and sketches allow for, of one sorted run: range search of the whole
    labels, then of prefixes that are shorter by a value each."""
    found, key, entry = [], np.ascontiguousarray(old["key"]), runs["entry"].astype(np.int64)
    there = lk.Entries(old["size"], old["sketch"], threshold)
    at, label, sorted_labels = s["entry"].astype(np.int64), np.ascontiguousarray(s["label"]), np.ascontiguousarray(runs["label"])
    lo = hi = None
    for level in range(DEEPER + 1):  # from the whole label to the widest prefix
        low = label >> np.uint64(8 * level) << np.uint64(8 * level)
        a, b = np.searchsorted(sorted_labels, low, "left"), np.searchsorted(sorted_labels, low + np.uint64((1 << (8 * level)) - 1), "right")
        copies = []
        for begin, end in ((a, b),) if lo is None else ((a, lo), (hi, b)):
            for i, j in expanded(begin, end):
                x, y = at[i], entry[j]
                ok = mine.close(x, there, y)
                x, y = x[ok], y[ok]
                found.append(np.stack([own[x], key[y]]))
                copies.append(x[own[x] == key[y]])
        lo, hi = a, b
        going = ~np.isin(at, np.concatenate(copies)) if copies else np.ones(len(at), bool)
        at, label, lo, hi = at[going], label[going], lo[going], hi[going]
    return found


def merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Entries and sorted labels of all runs of a bucket; copies of a text once."""
    entries, labels, n = [np.zeros(0, ENTRY)], [np.zeros(0, SIGNED)], 0
    for e, s in zip(t["entries"].to_pylist(), t["labels"].to_pylist(), strict=True):
        e, s = np.frombuffer(e, ENTRY), np.frombuffer(s, SIGNED).copy()
        s["entry"] += n
        n += len(e)
        entries.append(e)
        labels.append(s)
    e, s = np.concatenate(entries), np.concatenate(labels)
    _, first, number = np.unique(e["key"], return_index=True, return_inverse=True)
    s["entry"] = number[s["entry"]] if len(e) else s["entry"]
    order = np.lexsort((s["entry"], s["label"]))
    s = s[order]
    if len(s):
        s = s[np.append(True, (s["label"][1:] != s["label"][:-1]) | (s["entry"][1:] != s["entry"][:-1]))]
    return e[first], s


def expanded(lo: np.ndarray, hi: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j in lo[i]:hi[i], in blocks of bounded size."""
    size = np.maximum(hi - lo, 0)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, chunk):
        k = np.arange(a, min(a + chunk, total))
        i = np.searchsorted(ends, k, "right")
        yield i, lo[i] + (k - (ends[i] - size[i]))


def decided(t: pa.Table) -> pa.Table:
    """Keys that are found, of some links (_late, _early, _fl: the later one's first arrival), in order of arrival. A row
    without an earlier one says that the key repeats a stored text."""
    early = t["_early"]
    marks = t.filter(early.is_null())["_late"].to_pylist()
    links = t.filter(early.is_valid())
    late, early, order = (links[c].to_numpy() for c in ("_late", "_early", "_fl"))
    found = set(marks)
    for i in np.lexsort((late, order)).tolist():
        if int(early[i]) not in found:
            found.add(int(late[i]))
    return pa.table({"_key": pa.array(sorted(found), pa.int64())})


def _ordered(both: DataFrame) -> DataFrame:
    """Links with the first arrivals of both sides as (_late, _early, _fl)."""
    swap = (F.col("_fa") > F.col("_fb")) | ((F.col("_fa") == F.col("_fb")) & (F.col("_a") > F.col("_b")))
    return both.select(F.when(swap, F.col("_a")).otherwise(F.col("_b")).alias("_late"), F.when(swap, F.col("_b")).otherwise(F.col("_a")).alias("_early"), F.greatest("_fa", "_fb").alias("_fl"))


def resolve(classes: DataFrame, stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys (_key) of the classes that repeat something accepted.

    classes: (_key, _first arrival); stored: (_key) that repeat a stored text; edges: (_a, _b) links between classes.
    In order of first arrival a class is found if it is stored's or linked with an accepted earlier one. Classes without
    an earlier undecided neighbour are accepted at once, and what they link to is found. What ROUNDS such rounds leave
    undecided are long chains: a component of up to COMPONENT links is decided in order by one task, larger ones go on in
    rounds, however many it takes."""
    first = classes.select("_key", "_first")
    ordered = _ordered(edges.join(first.toDF("_a", "_fa"), "_a").join(first.toDF("_b", "_fb"), "_b"))
    known = cut(stored.select("_key").distinct(), "found")
    parts = [known]
    left = cut(ordered.distinct().join(known.toDF("_late"), "_late", "left_anti").join(known.toDF("_early"), "_early", "left_anti"), "undecided")
    n = 0
    while not left.isEmpty():
        n += 1
        if n % ROUNDS:
            heads = left.select(F.col("_early").alias("_key")).distinct().join(left.select(F.col("_late").alias("_key")), "_key", "left_anti")
            new = cut(left.join(heads.toDF("_early"), "_early", "left_semi").select(F.col("_late").alias("_key")).distinct(), "found")
            rest = left.join(new.toDF("_late"), "_late", "left_anti").join(new.toDF("_early"), "_early", "left_anti").join(heads.toDF("_early"), "_early", "left_anti")
        else:
            group = components(left.select(F.col("_late").alias("_a"), F.col("_early").alias("_b"))).withColumnRenamed("_key", "_late")
            grouped = cut(left.join(group, "_late"), "undecided-groups")
            small = grouped.groupBy("_group").agg(F.count("*").alias("_c")).filter(F.col("_c") <= COMPONENT).select("_group")
            new = cut(grouped.join(small, "_group", "left_semi").groupBy("_group").applyInArrow(decided, "_key bigint"), "found")
            rest = grouped.join(small, "_group", "left_anti").select(*left.columns)
        parts.append(new)
        if len(parts) > 2 * ROUNDS:  # so that what is found stays few files
            parts = [cut(_union(parts), "found")]
        after = cut(rest, "undecided")
        discard(left)
        left = after
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def classes_of(forest: HashForest, members: DataFrame) -> DataFrame:
    """The signed classes of a batch (_no, _key, _n, _features): a row per key, with its first arrival (_first), written."""
    classes = members.groupBy("_key").agg(F.first("_n").alias("_n"), F.first("_features").alias("_features"), F.min("_no").alias("_first"))
    return cut(forest.signed(classes), "batch-signed")


def repeated_in(forest: HashForest, members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a batch (_no, _key) and its classes, what repeats something that the forest holds or an accepted earlier arrival of
    the batch: arrivals (_no), written, and classes (_key). The forest stays as it is."""
    links = forest.search(classes)
    first = classes.select("_key", "_first")
    stored, edges = links.filter("_stored").select(F.col("_a").alias("_key")), links.filter("not _stored").select("_a", "_b")
    if links.count() <= COMPONENT:  # so many one task decides in order
        a, b = first.toDF("_a", "_fa"), first.toDF("_b", "_fb")
        own = _ordered(edges.join(a, "_a").join(b, "_b")).select("_late", "_early", "_fl")
        marks = stored.select(F.col("_key").alias("_late"), F.lit(None).cast("bigint").alias("_early"), F.lit(None).cast("bigint").alias("_fl"))
        found = own.unionByName(marks).groupBy(F.lit(0).alias("_group")).applyInArrow(decided, "_key bigint")
    else:
        found = resolve(first, stored, edges)
    found = cut(found, "batch-keys")
    keyed = members.select("_no", "_key").join(first, "_key").join(found.select("_key", F.lit(True).alias("_found")), "_key", "left")
    out = cut(keyed.filter("_found or _no > _first").select("_no").distinct(), "batch-found")
    discard(links)
    return out, found


def add_batch(forest: HashForest, members: DataFrame) -> DataFrame:
    """The arrivals of a batch (_no, _key, _n, _features) that are found (_no); the others are accepted into the forest."""
    classes = classes_of(forest, members)
    out, found = repeated_in(forest, members, classes)
    forest.accept(classes.join(found, "_key", "left_anti").drop("_first"))
    discard(classes)
    discard(found)
    return out


def repeated_arrivals(history: DataFrame, arrivals: DataFrame, text_col: str = "text", order_col: str = "arrival_no", batch_col: str | None = None, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, path: str | None = None, together: float = TOGETHER) -> DataFrame:
    """(order_col) of every arrival that repeats a text of the history or of an accepted earlier arrival; once each.

    The history is signed once into a forest (in ``path``, or in a new folder of the shared one), each batch once; batches
    are searched and accepted one after the other, in the order of their first arrivals. Whether an arrival is found
    depends on its order alone, so a batch is what arrives before the next one's first, or all without batch_col; and
    batches that wait are taken together until they hold a share of ``together`` of the history, as one pass reads the
    forest once however small the batch is (0: each by itself).
    Texts of fewer than 20 or more than 400 words, null and empty ones are neither found nor compared with. Repeated rows
    of an arrival count once, arrivals with a null order are left out, empty tables give an empty result.
    """
    spark = history.sparkSession
    forest = HashForest.create(spark, path or f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}", threshold, trees, recall, rows=history.count())
    forest.accept(lk.text_rows(history.select(F.col(text_col).alias("_text")), [], "_text"))
    usable = arrivals.filter(F.col(order_col).isNotNull())
    fresh = usable.select(F.col(order_col).alias("_no"), F.col(text_col).alias("_text"))
    came = cut(lk.text_rows(fresh, ["_no"], "_text"), "arrivals")
    waiting = [] if batch_col is None else sorted((r["_f"], r["_c"]) for r in usable.groupBy(batch_col).agg(F.min(order_col).alias("_f"), F.count("*").alias("_c")).collect())  # a row per batch
    firsts, held = [None], 0
    for begin, n in waiting:
        if held > together * forest.state["texts"]:
            firsts.append(begin)
            held = 0
        held += n
    found = []
    for begin, end in zip(firsts, [*firsts[1:], None], strict=True):
        batch = came
        if begin is not None:
            batch = batch.filter(F.col("_no") >= begin)
        if end is not None:
            batch = batch.filter(F.col("_no") < end)
        found.append(add_batch(forest, batch) if end is not None else repeated_in(forest, batch, classes_of(forest, batch))[0])
    out = _union(found) if found else came.select("_no").limit(0)
    return out.withColumnRenamed("_no", order_col)
