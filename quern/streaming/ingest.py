"""Streams: pages that arrive become nodes of the stored index, book by book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.functions import vectors as V
from quern.operators.bookindex import BookIndex
from quern.operators.segments import BUCKETS
from quern.plans.tables import written


def ingest(pages: DataFrame, root: str, checkpoint: str, size: int = 1200, overlap: int = 180, embed=V.hash_embedding, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that brings the pages of each micro-batch into the index below ``root``.

    The index keeps the pages beside the nodes: a page replaces the one of its book and number, and the books of a
    batch are built again from all their pages, so a book may arrive in several batches.  A batch reads the buckets
    of its books and writes its books alone.  The index remembers the last batch of each checkpoint: one that is
    replayed changes and writes nothing.  Of pages repeated within a batch any one counts; null texts count as empty
    pages; a book's title is the least of its pages'.
    """
    columns = ["book_id", "title", "page_num", "text", "image_ids", "ocr_texts"]

    def replace(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = BookIndex(spark, root, embed, buckets, size, overlap)
        streams = index.tables.manifest["about"].get("streams", {})
        if number <= streams.get(checkpoint, -1) or batch.isEmpty():
            return
        arrived = written(batch.select(*columns).dropDuplicates(["book_id", "page_num"]), "arrived")
        books = arrived.select("book_id").distinct()
        known = index.tables.before("pages", books).select(*columns)
        kept = written(known.join(arrived.select("book_id", "page_num"), ["book_id", "page_num"], "left_anti").unionByName(arrived), "kept")
        index.upsert(kept.groupBy("book_id").agg(F.min("title").alias("title")), kept, about={"streams": streams | {checkpoint: number}})

    return pages.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)


def arrivals(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; those later than the watermark go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
