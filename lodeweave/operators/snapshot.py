"""The store: chunks, vectors and BM25 postings that change together, in versions.

Chunks are kept in BUCKETS parts by their document. A commit writes the parts that it changes into a folder of a fresh
name, and then a pointer file of the next version that names the folder of every part; unchanged parts stay where they
are. Readers take the greatest pointer and stay with that version. A failed write leaves no pointer and is never seen, and
of two writers that plan the same version one gets an error, with nothing of the other's touched.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basename
from . import compliance
from .bm25 import BM25Index

MAX_METADATA_BYTES = 40 * 1024
BUCKETS = 64
POSTINGS = "term string, id string, dl int, tf bigint"
PATHS = "source_path string, document_id string, landed_at timestamp"


class ChunkStore:
    """A store under a path. Relations: chunks (unique chunk_id, with embedding if given), the BM25 index of their texts,
    and, where documents come by path, which document a path has."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, path = self._fs()
        folder = path(f"{self.path}/pointers")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getLen()) if fs.exists(folder) else []

    def _state(self, version: int | None = None) -> dict:
        v = version if version is not None else next(iter(reversed(self.versions())), None)
        if v is None:
            return {"version": 0, "parts": {}, "schema": None, "paths": None}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{v:012d}", wholetext=True).first()[0])

    def _commit(self, state: dict) -> int:
        state = state | {"version": state["version"] + 1}
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.path}/pointers/{state['version']:012d}"), False)
        except Exception as e:
            raise RuntimeError(f"version {state['version']} was committed by another writer") from e
        out.write(json.dumps(state).encode())
        out.close()
        return state["version"]

    def _read(self, state: dict, relation: str, parts: list[str] | None = None) -> DataFrame:
        schema = POSTINGS if relation == "postings" else state["schema"]
        folders = [f"{self.path}/{f}/{relation}/_bucket={b}" for b, f in state["parts"].items() if parts is None or b in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def chunks(self, version: int | None = None) -> DataFrame | None:
        state = self._state(version)
        return self._read(state, "chunks") if state["version"] else None

    def index(self, version: int | None = None) -> BM25Index | None:
        state = self._state(version)
        return BM25Index.of_postings(self._read(state, "postings"), self._read(state, "chunks").agg(F.count("*").alias("n"))) if state["version"] else None

    def paths(self, version: int | None = None) -> DataFrame:
        """(source_path, document_id, landed_at): the document that each path has."""
        at = self._state(version)["paths"]
        return self.spark.read.schema(PATHS).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], PATHS)

    def _change(self, state: dict, fresh: DataFrame, gone: DataFrame | None = None, paths: DataFrame | None = None) -> int:
        """Commit ``fresh`` chunks in place of those of the same ids, without the ids of ``gone``. Only parts that hold
        chunks of either are read and written."""
        if "legal_metadata" in fresh.columns:
            size = F.octet_length(F.to_json("legal_metadata"))
            fresh = fresh.withColumn("legal_metadata", F.when(F.coalesce(size, F.lit(0)) <= MAX_METADATA_BYTES, F.col("legal_metadata")).otherwise(F.raise_error(F.concat(F.lit("metadata too large: "), F.col("chunk_id")))))
        at = f"w-{uuid.uuid4().hex}"
        fresh.write.parquet(f"{self.path}/{at}/fresh")  # read several times
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/{at}/fresh")
        ids = fresh.select("chunk_id") if gone is None else fresh.select("chunk_id").unionByName(gone.select("chunk_id"))
        touched, rows = fresh.select(_bucket().alias("b")), fresh
        if state["parts"]:
            held = self._read(state, "chunks")
            touched = touched.unionByName(held.join(ids, "chunk_id", "left_semi").select(_bucket().alias("b")))
        changed = [str(r["b"]) for r in touched.distinct().collect()]  # at most BUCKETS rows
        if state["parts"] and any(b in state["parts"] for b in changed):
            rows = self._read(state, "chunks", changed).join(ids, "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
        rows = rows.withColumn("_bucket", _bucket())
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{at}/chunks")
        schema = rows.drop("_bucket").schema
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{at}/chunks")
        BM25Index.postings_of(written, "chunk_id", "text", "_bucket").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{at}/postings")
        fs, path = self._fs()
        parts = {b: f for b, f in state["parts"].items() if b not in changed}
        for b in changed:
            if fs.exists(path(f"{self.path}/{at}/chunks/_bucket={b}")):
                parts[b] = at
                fs.mkdirs(path(f"{self.path}/{at}/postings/_bucket={b}"))  # texts without a word have no postings
        fs.delete(path(f"{self.path}/{at}/fresh"), True)
        if paths is not None:
            paths.write.parquet(f"{self.path}/{at}/paths")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        return self._commit(state | {"parts": parts, "schema": ddl, "paths": f"{at}/paths" if paths is not None else state["paths"]})

    def write(self, chunks: DataFrame) -> int:
        """A new version of these chunks alone. A chunk whose metadata exceeds 40 kB is an error."""
        return self._change(self._state() | {"parts": {}}, chunks)

    def upsert(self, chunks: DataFrame, superseding: bool = False) -> int:
        """New chunks replace stored ones of the same id. If ``superseding``, the same commit marks what the new chunks'
        provisions supersede, in the store and among them."""
        state, fresh = self._state(), chunks.dropDuplicates(["chunk_id"])
        if superseding:
            held = self._read(state, "chunks").join(fresh.select("chunk_id"), "chunk_id", "left_anti") if state["parts"] else fresh.limit(0)
            every = held.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)), allowMissingColumns=True)
            meta = [F.col(f"legal_metadata.{f}").alias(f) for f in (*compliance.IDENTITY, "effective_date", "is_current", "superseded_by")]
            flags = compliance.supersede(every.filter("legal_metadata is not null").select("chunk_id", "document_id", "_new", *meta), new=F.col("_new"))
            changed = flags.filter(~F.col("new_is_current").eqNullSafe(F.col("is_current"))).select("chunk_id", F.col("new_is_current").alias("_c"), F.col("new_superseded_by").alias("_s"), F.lit(True).alias("_hit"))
            meta = F.col("legal_metadata").withField("is_current", F.col("_c")).withField("superseded_by", F.col("_s"))
            joined = every.join(changed, "chunk_id", "left").filter(F.col("_new") | F.col("_hit"))
            fresh = joined.withColumn("legal_metadata", F.when(F.col("_hit"), meta).otherwise(F.col("legal_metadata"))).drop("_new", "_c", "_s", "_hit")
        return self._change(state, fresh)

    def delete_document(self, document_id: str) -> int:
        """Without a document's chunks, vectors and postings; they vanish together."""
        state = self._state()
        held = self._read(state, "chunks")
        return self._change(state, held.limit(0), held.filter(F.col("document_id").eqNullSafe(F.lit(document_id))))

    def replace(self, chunks: DataFrame, gone: DataFrame, paths: DataFrame) -> int:
        """New chunks, without the chunks of the documents of ``gone`` (document_id), with a new relation of paths."""
        state = self._state()
        lost = self._read(state, "chunks").join(gone.select("document_id").distinct(), "document_id", "left_semi") if state["parts"] else None
        return self._change(state, chunks, lost, paths)

    def update_metadata(self, changes: DataFrame) -> int:
        """is_current and superseded_by of the given chunk ids; a null in ``changes`` leaves is_current as it is."""
        state = self._state()
        new = changes.select("chunk_id", F.col("is_current").alias("_c"), F.col("superseded_by").alias("_s"))
        held = self._read(state, "chunks").filter("legal_metadata is not null").join(new, "chunk_id")
        meta = F.col("legal_metadata").withField("is_current", F.coalesce("_c", F.col("legal_metadata.is_current"))).withField("superseded_by", F.col("_s"))
        return self._change(state, held.withColumn("legal_metadata", meta).drop("_c", "_s"))

    def get(self, chunk_id: str) -> DataFrame:
        return self.chunks().filter(F.col("chunk_id") == chunk_id)

    def by_document(self, document_id: str) -> DataFrame:
        """One document's chunks, from the part that holds it."""
        state = self._state()
        part = str(self.spark.range(1).select(_bucket(F.lit(document_id)).alias("b")).first()[0])
        return self._read(state, "chunks", [part]).filter(F.col("document_id") == document_id).orderBy("chunk_index", "chunk_id")

    def drift(self) -> DataFrame:
        """Ids that only the chunks or only the postings have (texts without any word have no postings and don't count)."""
        worded = self.chunks().filter(F.lower("text").rlike("[a-z0-9_]")).select("chunk_id")
        return drift(worded, self.index().postings.select(F.col("id").alias("chunk_id")))


def _bucket(document_id: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.col("document_id") if document_id is None else document_id), F.lit(BUCKETS)).cast("int")


def drift(left: DataFrame, right: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, side) of ids on one side only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").filter("_l is null or _r is null")
    return both.select(key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def change_state(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds state to found documents (source_path, document_id): new, unchanged or changed against the known hash of their path."""
    k = known.select("source_path", F.col("document_id").alias("_known")).dropDuplicates(["source_path"])
    return found.join(k, "source_path", "left").withColumn("state", F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("document_id"), "unchanged").otherwise("changed")).drop("_known")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a checkpoint doesn't have yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def document_summaries(chunks: DataFrame, time: str = "ingested_at", paths: DataFrame | None = None) -> DataFrame:
    """(document_id, chunk_count, indexed_at, and, with paths, source_path: the first of a document's)."""
    out = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.min(time).alias("indexed_at"))
    if paths is None:
        return out
    return out.join(paths.groupBy("document_id").agg(F.min("source_path").alias("source_path")), "document_id", "left")


def listing(summaries: DataFrame) -> DataFrame:
    """Summaries as a listing shows them: last indexed first, then by document."""
    return summaries.orderBy(F.desc("indexed_at"), "document_id")


def totals(summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents and chunks of summaries (document_id, chunk_count), by the given columns; null documents count no document."""
    return summaries.groupBy(*(by or [])).agg(F.count_distinct("document_id").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def document_detail(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries with the first chunk's metadata and the first 1000 characters."""
    first = chunks.groupBy("document_id").agg(F.min_by(F.struct("legal_metadata", F.substring("text", 1, 1000).alias("preview")), F.struct("chunk_index", "chunk_id")).alias("_f"))
    return summaries.join(first, "document_id", "left").select(*summaries.columns, "_f.legal_metadata", "_f.preview")


def named(documents: DataFrame, part: str, path_col: str = "source_path") -> DataFrame:
    """Documents whose file name holds ``part``, whatever the case; blank paths never."""
    name = F.lower(basename(F.col(path_col)))
    return documents.filter((F.trim(path_col) != "") & F.contains(name, F.lit(part.lower())))


def file_names(documents: DataFrame, path_col: str = "source_path") -> DataFrame:
    """(document_id, filename): the first file name of every document that has one."""
    known = documents.filter(F.trim(path_col) != "")
    return known.groupBy("document_id").agg(basename(F.min(path_col)).alias("filename"))
