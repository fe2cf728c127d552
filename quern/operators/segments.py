"""Tables in segments: what a batch of books adds or replaces is written beside what is there, and old rows are masked.

A segment is the folder of one version.  It holds some tables, each in one
folder for each bucket of books, and the table ``books`` of those that it
brings or takes away.  A version is a manifest: the segments, in their order,
with the buckets of each that still count.  A row counts if no later segment
names its book.  So a batch writes what its own books need, whatever the size
of the index; ``compact`` merges buckets that have come to have many segments.

Writers work on the version that they have read; one that another has
overtaken is told so and changes nothing.  A folder that no manifest names, as
a killed writer leaves it, is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import store
from quern.plans.tables import drop, few, folders, shuffles_freed, written

BUCKETS = 64
MOST_SEGMENTS = 8
BOOKS = "book_id string, removed boolean"


def bucket(book: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(buckets)).cast("int")


class Segments:
    """The current version of the segmented tables below ``root``; tables: name -> schema (without bucket), each with a book_id.

    ``sums`` names columns of the table ``books`` that the manifest adds up over the books that count.  Tables in
    ``deltas`` (name -> key) have no rows by book but integer changes in ``change`` by key: a batch writes what its
    books add, less what they had added before.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], deltas: dict[str, str] | None = None, sums: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.root, self.deltas, self.sums = spark, root.rstrip("/"), deltas or {}, sums
        self.tables = tables | {"books": ", ".join([BOOKS, *(f"{c} bigint" for c in sums)])}
        self.refresh(buckets)

    def refresh(self, buckets: int = BUCKETS) -> None:
        self.version = store.current(self.spark, self.root)
        found = store.read_text(self.spark, f"{self.root}/{self.version}/segments.json") if self.version else None
        if self.version and found is None:
            raise RuntimeError("the stored index has no segments; build it anew")
        self.manifest = json.loads(found) if found else {"buckets": buckets, "segments": [], "next": 0, "masked": 0, "totals": {}, "about": {}}
        self.buckets = self.manifest["buckets"]

    @property
    def totals(self) -> dict[str, int]:
        return {c: self.manifest["totals"].get(c, 0) for c in self.sums}

    def _segment(self, segment: dict, table: str, wanted: set[int] | None) -> DataFrame | None:
        there = [b for b in segment["tables"].get(table, []) if b in segment["active"] and (wanted is None or b in wanted)]
        if not there:
            return None
        base = f"{self.root}/{segment['name']}/{table}"
        paths = [f"{base}/bucket={b}" for b in there] if len(there) < len(segment["tables"][table]) else [base]
        found = self.spark.read.option("basePath", base).schema(f"{self.tables[table]}, bucket int").parquet(*paths)
        return found.withColumn("seq", F.lit(segment["seq"]))

    def raw(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """All rows of the segments, masked ones too, with bucket and seq."""
        out = None
        wanted = {*buckets} if buckets is not None else None
        for segment in ({**s, "active": {*s["active"]}} for s in self.manifest["segments"]):
            if (rows := self._segment(segment, table, wanted)) is not None:
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"{self.tables[table]}, bucket int, seq int")

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """The rows that count; of some buckets only, whose folders alone are read."""
        if table in self.deltas:
            return self.raw(table, buckets).groupBy(self.deltas[table]).agg(F.sum("change").alias("change")).where("change <> 0")
        rows = self.raw(table, buckets)
        if self.manifest["masked"]:
            books = self.raw("books", buckets).select("book_id", "seq")
            last = books.groupBy("book_id").agg(F.max("seq").alias("last"))
            masked = books.join(last, "book_id").where("seq < last").select("book_id", "seq")
            rows = rows.join(few(masked, self.manifest["masked"]), ["book_id", "seq"], "left_anti")
        return (rows.where("not removed") if table == "books" else rows).drop("seq")

    def touched(self, books: DataFrame) -> set[int]:
        """The buckets of some books: at most as many as there are buckets."""
        return {r[0] for r in books.select(bucket(F.col("book_id"), self.buckets)).distinct().collect()}

    def replace(self, books: DataFrame, make: dict[str, Callable[[], DataFrame] | DataFrame], gone: DataFrame | None = None, about: dict | None = None, late: dict[str, dict[str, Column]] | None = None, spent: tuple[DataFrame, ...] = ()) -> str:
        """A new version in which the rows of ``make`` (table -> rows, or a function that is called when the tables before it are written) are all that counts of ``books`` (book_id and the sums), and nothing is left of those in ``gone`` (book_id).

        A delta table's function gives what the new books add, (key, bucket, change); what the old ones had added is
        taken off by the same function over their old rows, see ``before``.  ``late`` has columns (table -> name ->
        column) that are made of the others as rows are written.  Written tables in ``spent`` that ``make`` names are
        deleted as soon as their rows are in the segment: nothing else may need them then.
        """
        zero = [F.lit(0).cast("long").alias(c) for c in self.sums]
        named = books.select("book_id", F.lit(False).alias("removed"), *self.sums)
        if gone is not None:
            named = named.unionByName(gone.select("book_id").distinct().join(books.select("book_id"), "book_id", "left_anti").select("book_id", F.lit(True).alias("removed"), *zero))
        named = written(named, "named")
        touched = self.touched(named)
        old = self.read("books", touched).join(named.select("book_id"), "book_id", "left_semi")
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.sums]
        before, after = old.agg(F.count("*").alias("n"), *sums).first(), named.agg(*sums, F.count("*").alias("n")).first()
        version = self._name()
        self._write(version, "books", named)
        for table, rows in make.items():
            self._write(version, table, rows() if callable(rows) else rows, (late or {}).get(table))
            if any(rows is x for x in spent):
                drop(self.spark, folders(rows))
        segment = {"name": version, "seq": self.manifest["next"], "tables": {t: self._written(version, t) for t in ["books", *make]}, "active": sorted(touched)}
        new = self.manifest | {"segments": [*self.manifest["segments"], segment], "next": self.manifest["next"] + 1, "masked": self.manifest["masked"] + before.n, "about": self.manifest["about"] | (about or {})}
        new["totals"] = {c: self.totals[c] - before[c] + after[c] for c in self.sums}
        self._commit(version, new)
        return version

    def before(self, table: str, books: DataFrame) -> DataFrame:
        """The rows of ``table`` that counted for some books; only their buckets' folders are read."""
        return self.read(table, self.touched(books)).join(books.select("book_id").distinct(), "book_id", "left_semi")

    def crowded(self, most: int = MOST_SEGMENTS) -> set[int]:
        held: dict[int, int] = {}
        for s in self.manifest["segments"]:
            for b in s["active"]:
                held[b] = held.get(b, 0) + 1
        return {b for b, n in held.items() if n > most}

    def compact(self, most: int = MOST_SEGMENTS) -> set[int]:
        """Merges the buckets that have more than ``most`` segments, each to one; returns them."""
        wanted = self.crowded(most)
        if not wanted:
            return wanted
        version = self._name()
        for table in self.tables:
            if table in self.deltas:
                key = self.deltas[table]
                rows = self.raw(table, wanted).groupBy("bucket", key).agg(F.sum("change").alias("change")).where("change <> 0")
            else:
                rows = self.read(table, wanted)
            self._write(version, table, rows)
        segment = {"name": version, "seq": self.manifest["next"], "tables": {t: self._written(version, t) for t in self.tables}, "active": sorted(wanted)}
        kept = [s | {"active": [b for b in s["active"] if b not in wanted]} for s in self.manifest["segments"]]
        new = self.manifest | {"segments": [*(s for s in kept if s["active"]), segment], "next": self.manifest["next"] + 1}
        self.manifest, old = new, self.manifest
        books = self.raw("books")
        new["masked"] = books.count() - books.select("book_id").distinct().count()
        self.manifest = old
        self._commit(version, new)
        return wanted

    def _name(self) -> str:
        return f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"

    def _write(self, version: str, table: str, rows: DataFrame, late: dict[str, Column] | None = None) -> None:
        """A folder for each bucket; a bucket of very many rows is split over tasks, and rows are in the order of their first column.  Columns in ``late`` are made after rows are dealt."""
        columns = [c.strip().split(" ")[0] for c in self.tables[table].split(", ")]
        if "bucket" not in rows.columns:
            rows = rows.withColumn("bucket", bucket(F.col("book_id"), self.buckets))
        dealt = rows.select(*[c for c in columns if c not in (late or {})], "bucket").hint("rebalance", "bucket").sortWithinPartitions("bucket", columns[0])
        dealt = dealt.withColumns(late or {}).select(*columns, "bucket")
        with shuffles_freed(self.spark):
            dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{version}/{table}")

    def _written(self, version: str, table: str) -> list[int]:
        names = store.names(self.spark, f"{self.root}/{version}/{table}")
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("bucket="))

    def _commit(self, version: str, manifest: dict) -> None:
        meta = {f"num_{c}": n for c, n in manifest["totals"].items()} | {"buckets": manifest["buckets"]} | manifest["about"]
        store.write_text(self.spark, f"{self.root}/{version}/segments.json", json.dumps(manifest))
        store.write_text(self.spark, f"{self.root}/{version}/meta.json", json.dumps(meta))
        if store.current(self.spark, self.root) != self.version:
            raise RuntimeError("another writer has changed the index")
        store.activate(self.spark, self.root, version)
        self.version, self.manifest = version, manifest
