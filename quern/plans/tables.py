"""Intermediate tables in the folder that the cluster shares: lineage ends at them, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where the session names none and runs on this machine alone (as in tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quern-{purpose}-{uuid.uuid4().hex}"


_OPEN = threading.local()  # the folders written within each ``scratch`` that this thread has open
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table, read back."""
    path = folder(df.sparkSession, purpose)
    if open_here := _open():
        open_here[-1].append(path)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _open() -> list[list[str]]:
    if not hasattr(_OPEN, "folders"):
        _OPEN.folders = []
    return _OPEN.folders


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within go when each of them ends, not when their plans are collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end: for work whose result is stored elsewhere by then."""
    _open().append([])
    try:
        yield
    finally:
        drop(spark, _open().pop())


def folders(table: DataFrame) -> list[str]:
    """The folder of a written table."""
    return sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()})


def kept(table: DataFrame) -> DataFrame:
    """A written table that the innermost ``scratch`` leaves to the one around it."""
    name = {f.rsplit("/", 1)[1] for f in folders(table)}
    here = _open()
    mine = [p for p in here[-1] if p.rsplit("/", 1)[1] in name]
    here[-1] = [p for p in here[-1] if p not in mine]
    if len(here) > 1:
        here[-2] += mine
    return table


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a table's scan over all cores, where its files have fewer parts than there are cores: for work that is heavy for each row.  A large table has more parts, and stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The (narrow) table marked for broadcast if it has at most BROADCAST_ROWS rows (counted, unless the number is known); else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


BATCH_ROWS = 1000


def modest_batches(df: DataFrame, rows: int = BATCH_ROWS) -> None:
    """Makes the session's Arrow batches small enough for texts and vectors: each is held several times over, by the JVM and by Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
