"""Session helpers: defaults for local runs, the shared folder for cut lineage, shipping of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodeweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.driver.memory", memory)
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-lodeweave-warehouse-"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; set to a local one only where it is unset and the master
    is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lodeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _cuts.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodeweave_cut = path
    return out


_cuts: dict[str, list[str]] = {}  # of each application


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a DataFrame that ``cut`` gave, once nothing that is still to run reads it."""
    path = df._lodeweave_cut
    _delete(df.sparkSession, path)
    _cuts.get(df.sparkSession.sparkContext.applicationId, [path]).remove(path)


def release(spark: SparkSession) -> None:
    """Have the driver look for what nothing refers to any more, so that shuffle files of finished jobs are deleted now and
    not when its memory is short; for loops that write much."""
    spark.sparkContext._jvm.java.lang.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all folders that ``cut`` wrote within: results must have been written elsewhere by then."""
    held = _cuts.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    try:
        yield
    finally:
        for path in held[before:]:
            _delete(spark, path)
        del held[before:]


def ensure_importable(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have the repository on their path."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_lodeweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-lodeweave-zip-")) / "lodeweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "lodeweave").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._lodeweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer splits than there are, as small tables of one file do; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
