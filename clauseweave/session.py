"""Session defaults and small helpers shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "clauseweave", **overrides: str) -> SparkSession:
    """A session with adaptive execution on; everything else is left to the cluster."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(overrides)
    builder = SparkSession.builder.appName(app_name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors could not read each other's files there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="clauseweave-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``cut_lineage`` stores inside, but for tables stored with ``keep``."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            remove_path(spark, path)


#: Set while a table is stored: its shuffle files go when the write ends, and
#: ``by`` splits the rows over open files without sorting them first.
_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "64"}


@contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every job inside go when that job ends, not when the driver collects its garbage."""
    before = {k: spark.conf.get(k) for k in _STORING}
    for k, v in _STORING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _store(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    with storing(spark):
        df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, keep: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder so later passes do not recompute it.

    A table rather than an RDD checkpoint: later passes read single columns of
    it, and its known size lets Spark choose joins. It survives lost executors.
    What was shuffled for it leaves the disk with the write. ``by`` names columns
    whose values get folders of their own, so that a filter on them reads no more.
    Inside ``scratch`` it goes when that ends; with ``keep`` it outlives it.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    open_ = _SCRATCH.get()
    open_ = open_[:-1] if keep else open_
    if open_:
        open_[-1].append(path)
    return _store(df, path, by)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_stored(df: DataFrame) -> None:
    """Delete the table behind a ``cut_lineage`` result that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove_path(df.sparkSession, file.rsplit("/", 1)[0])


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder; an error if nothing is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``cut_lineage`` for a job that ends here: the table is deleted on leaving."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    try:
        yield _store(df, path)
    finally:
        remove_path(spark, path)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Store a narrow result and broadcast it only when its counted size allows.

    Beyond the limit it is returned as a plain table for a shuffled join.
    """
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a source that is read in fewer splits than there are cores.

    Text and vector work is row-local, so a source of one large row group would
    leave most cores idle. Sources with enough splits are returned unchanged:
    at scale this adds no shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
