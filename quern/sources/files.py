"""Datasets of many files (images, masks, labels by class) as a Spark sink with two phases.

Tasks write each file into a folder of their own attempt, below ``_staging`` of the dataset's root, with a list of
what they wrote.  The commit names the attempts that count, a row a task, and sweeps the others.  Publishing is a second
Spark job over those lists: each file is moved to its place, and what was moved is the manifest.  A move that has been
done already counts as done, so publishing can be repeated: ``resume`` finishes what a lost driver left committed.

Defined results: rows are (path, content); paths are relative and without ".." (null, empty or other paths are
errors); null content is an empty file; two rows of one path are an error and nothing is published; a table without
rows gives an empty manifest; a root that has a manifest is not written again; other columns are not read.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING, COMMITTED = "_staging", "_committed"
LISTED = "attempt string, path string, size bigint, crc32 bigint"
_LISTED = pa.schema([("attempt", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("crc32", pa.int64())])


def _open(root: str) -> tuple[FileSystem, str]:
    fs, base = FileSystem.from_uri(root)
    return fs, base.rstrip("/")


def checked(path: str | None) -> str:
    """The path, if it stays below the root and out of the folders that the sink itself uses."""
    parts = (path or "").split("/")
    if not path or any(x in ("", ".", "..") for x in parts) or parts[0] in (STAGING, "manifest"):
        raise ValueError(f"not a path within a dataset: {path!r}")
    return path


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class StagedFiles(DataSourceArrowWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        fs, base = _open(self.root)
        folder = f"{base}/{STAGING}/{self.job}/{attempt}"
        # one folder at a time: where an abort has removed the job's, a task that still runs fails instead of making it anew
        made: set[str] = set()

        def make(path: str) -> None:
            if path not in made and path != folder:
                make(posixpath.dirname(path))
            if path not in made:
                fs.create_dir(path, recursive=False)
                made.add(path)

        make(folder)
        rows: list[tuple[str, str, int, int]] = []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place, content = f"{folder}/files/{checked(path)}", content or b""
                make(posixpath.dirname(place))
                with fs.open_output_stream(place) as out:
                    out.write(content)
                rows.append((attempt, path, len(content), crc32(content)))
        with fs.open_output_stream(f"{folder}/list.parquet") as out:
            pq.write_table(pa.Table.from_pylist([dict(zip(_LISTED.names, r, strict=True)) for r in rows], _LISTED), out)
        return Attempt(attempt)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, base = _open(self.root)
        job = f"{base}/{STAGING}/{self.job}"
        kept = {m.name for m in messages if m is not None}
        for info in fs.get_file_info(FileSelector(job)):
            if info.type == FileType.Directory and info.base_name not in kept:
                fs.delete_dir(info.path)
        with fs.open_output_stream(f"{job}/{COMMITTED}") as out:
            out.write("\n".join(sorted(kept)).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        _sweep(self.root, self.job)


def _sweep(root: str, job: str, tries: int = 20) -> None:
    """Removes a job's staged files, and the staging folder if it was the last.  Tasks that still write may disturb a try."""
    fs, base = _open(root)
    folder = f"{base}/{STAGING}"
    for i in range(tries):
        try:
            if fs.get_file_info(f"{folder}/{job}").type == FileType.Directory:
                fs.delete_dir(f"{folder}/{job}")
            break
        except OSError:
            if i == tries - 1:
                raise
            time.sleep(0.1)
    if fs.get_file_info(folder).type == FileType.Directory and not fs.get_file_info(FileSelector(folder)):
        fs.delete_dir(folder)


class DatasetFiles(DataSource):
    """``df.write.format("dataset_files").option("path", root).option("job", name).mode("append")``: stages and commits; ``publish`` does the rest."""

    @classmethod
    def name(cls) -> str:
        return "dataset_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> StagedFiles:
        fs, base = _open(self.options["path"])
        fs.create_dir(f"{base}/{STAGING}/{self.options['job']}")
        return StagedFiles(self.options["path"], self.options["job"])


def publish(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Moves a committed job's files to their places; returns the manifest (path, size, crc32) as written."""
    fs, base = _open(root)
    with fs.open_input_stream(f"{base}/{STAGING}/{job}/{COMMITTED}") as f:
        attempts = f.read().decode().split()
    listed = spark.read.schema(LISTED).parquet(*[f"{root.rstrip('/')}/{STAGING}/{job}/{a}/list.parquet" for a in attempts]) if attempts else spark.createDataFrame([], LISTED)
    twice = listed.groupBy("path").count().where("count > 1").select("path").take(1)
    if twice:
        _sweep(root, job)
        raise ValueError(f"two rows have the path {twice[0].path!r}")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        made: set[str] = set()
        for batch in batches:
            for attempt, path, size in zip(*(batch.column(c).to_pylist() for c in ("attempt", "path", "size")), strict=True):
                source, place = f"{base}/{STAGING}/{job}/{attempt}/files/{path}", f"{base}/{path}"
                if (parent := posixpath.dirname(place)) not in made:
                    fs.create_dir(parent)
                    made.add(parent)
                try:
                    fs.move(source, place)
                except OSError:  # moved by an attempt before this one
                    if fs.get_file_info(place).size != size:
                        raise
            yield batch.select(["path", "size", "crc32"])

    manifest = f"{root.rstrip('/')}/manifest"
    listed.mapInArrow(move, "path string, size bigint, crc32 bigint").write.mode("overwrite").parquet(manifest)
    _sweep(root, job)
    return spark.read.parquet(manifest)


def published(root: str) -> bool:
    fs, base = _open(root)
    return fs.get_file_info(f"{base}/manifest/_SUCCESS").type == FileType.File


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (path, content) as files below the root; returns the manifest.  The root is a URI or an absolute path that all executors share."""
    if published(root):
        raise FileExistsError(f"{root} holds a dataset")
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DatasetFiles)
    rows.select(F.col("path").cast("string"), F.col("content").cast("binary")).write.format("dataset_files").option("path", root).option("job", job).mode("append").save()
    return publish(spark, root, job)


def resume(spark: SparkSession, root: str) -> DataFrame | None:
    """After a lost driver: publishes the job that had been committed, if there is one, and sweeps those that had not."""
    fs, base = _open(root)
    folder = f"{base}/{STAGING}"
    if fs.get_file_info(folder).type != FileType.Directory:
        return spark.read.parquet(f"{root.rstrip('/')}/manifest") if published(root) else None
    jobs = [i.base_name for i in fs.get_file_info(FileSelector(folder))]
    done = [j for j in jobs if fs.get_file_info(f"{folder}/{j}/{COMMITTED}").type == FileType.File]
    for job in set(jobs) - set(done[:1]):
        _sweep(root, job)
    return publish(spark, root, done[0]) if done else None
