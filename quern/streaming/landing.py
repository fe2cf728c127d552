"""Uploads: files that land in a folder become books of the stored index, or rows of a quarantine table that says why not."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators.bookindex import BookIndex
from quern.operators.segments import BUCKETS
from quern.plans.tables import written

FILES = "path string, modificationTime timestamp, length bigint, content binary"
QUARANTINE = "path string, file_name string, length bigint, modified timestamp, reason string"
MAGIC = b"%PDF-"  # fixed by the format
BLANK = 64  # only files of so few bytes are looked at for being blank


def checked(files: DataFrame) -> DataFrame:
    """Adds file_name (safe) and reason: why a file is no book (empty or only white space, type, content), null where it may be one."""
    content = F.coalesce(F.col("content"), F.lit(b""))
    blank = (F.length(content) <= BLANK) & (F.regexp_replace(F.decode(content, "ISO-8859-1"), r"\s", "") == "")
    reason = F.when(blank, "empty").when(~F.lower("path").endswith(".pdf"), "type").when(F.substring(content, 1, len(MAGIC)) != F.lit(MAGIC), "content")
    return files.withColumn("file_name", T.file_name(F.col("path"))).withColumn("reason", reason)


def decoded(files: DataFrame, decode: Callable[[bytes], tuple[str | None, list[str]]]) -> DataFrame:
    """(path, file_name, length, modified, title, page_num, text, reason): pages of files; one row with a reason for a file that cannot be read or has no page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                try:
                    title, texts = decode(r.content)
                    reason = None if texts else "no pages"
                except Exception as e:  # noqa: BLE001  whatever a decoder raises about a file is that file's
                    title, texts, reason = None, [], f"unreadable: {type(e).__name__}"
                yield pd.DataFrame({"path": r.path, "file_name": r.file_name, "length": r.length, "modified": r.modified, "title": title, "page_num": range(1, len(texts) + 1) if texts else [0], "text": texts or [None], "reason": reason})

    given = files.select("path", "file_name", "length", F.col("modificationTime").alias("modified"), "content")
    return given.mapInPandas(run, "path string, file_name string, length bigint, modified timestamp, title string, page_num int, text string, reason string")


def land(spark: SparkSession, folder: str, root: str, quarantine: str, checkpoint: str, decode: Callable[[bytes], tuple[str | None, list[str]]], embed=V.hash_embedding, buckets: int = BUCKETS, **cut) -> DataStreamWriter:
    """A writer that brings the PDF files of ``folder`` into the index below ``root`` as they arrive.

    A book's id comes from its file's name, so a later file of that name takes its place; of files of one batch with
    one name the last modified counts, the others are set aside as ``repeated``.  A batch's bad files are one folder of the quarantine table, written
    again where the batch is replayed; its books are committed with the batch's number, so a replay brings nothing
    twice.  Spark's file readers leave files of no bytes out: they give no row of either kind.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    def batch(arrived: DataFrame, number: int) -> None:
        if arrived.isEmpty():
            return
        seen = checked(arrived)
        pages = written(decoded(seen.where("reason is null"), decode), "decoded")
        stem = F.regexp_replace("file_name", r"(?i)\.pdf$", "")
        pages = pages.withColumn("book_id", T.slug(stem)).withColumn("stem", stem)
        last = pages.where("reason is null").groupBy("book_id").agg(F.max(F.struct("modified", "path")).alias("last"))
        pages = written(pages.join(F.broadcast(last), "book_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("path") != F.col("last.path"), "repeated"))).drop("last"), "landed")
        bad = seen.where("reason is not null").select("path", "file_name", "length", F.col("modificationTime").alias("modified"), "reason")
        bad = bad.unionByName(pages.where("reason is not null").select(*bad.columns).distinct())
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        index = BookIndex(spark, root, embed, buckets, **cut)
        streams = index.tables.manifest["about"].get("streams", {})
        good = pages.where("reason is null")
        if number <= streams.get(checkpoint, -1) or good.isEmpty():
            return
        books = good.groupBy("book_id").agg(F.min(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("stem"))).alias("title"))
        none = F.array().cast("array<string>")
        lines = F.array_join(F.filter(F.transform(T.lines(F.coalesce("text", F.lit(""))), T.collapse), lambda s: s != ""), "\n")
        index.upsert(books, good.select("book_id", "page_num", lines.alias("text"), none.alias("image_ids"), none.alias("ocr_texts")), about={"streams": streams | {checkpoint: number}})

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
