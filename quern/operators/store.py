"""The stored index: versioned Parquet tables, a pointer that moves last, upserts by book."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.tree import NODES

TABLES = ("nodes", "vectors", "postings")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.option("wholetext", True).text(path).first()[0]


def write_text(spark: SparkSession, path: str, value: str) -> None:
    """Writes a small file whole: a temporary name, then a rename that takes the old one's place, so that readers always see one of the two."""
    fs, p = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    temporary = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(value.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(p), overwrite)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def node_columns() -> list[str]:
    return [f.strip().split(" ")[0] for f in NODES.split(", ")]


def save(root: str, tables: dict[str, DataFrame], meta: dict | None = None, swap: bool = True) -> str:
    """Writes a new version below ``root``; readers see it once the pointer moves (not without ``swap``).  Older versions stay as backups."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
        counts[f"num_{name}"] = spark.read.parquet(f"{root}/{version}/{name}").count()
    write_text(spark, f"{root}/{version}/meta.json", json.dumps((meta or {}) | counts))
    if swap:
        activate(spark, root, version)
    return version


def activate(spark: SparkSession, root: str, version: str) -> None:
    write_text(spark, f"{root}/CURRENT", version)


def current(spark: SparkSession, root: str) -> str | None:
    return read_text(spark, f"{root}/CURRENT")


def is_complete(spark: SparkSession, root: str, tables: tuple[str, ...] = TABLES) -> bool:
    """Whether the current version has all tables, each written to its end, and its meta file."""
    version = current(spark, root)
    if version is None:
        return False
    fs, _ = _fs(spark, root)
    there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    return there(f"{root}/{version}/meta.json") and all(there(f"{root}/{version}/{t}/_SUCCESS") for t in tables)


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version: nodes, pages, vectors (node_id, vector) or postings of an index in segments, or what ``save`` was given."""
    version = current(spark, root)
    if version is None:
        raise RuntimeError("no index has been stored")
    if read_text(spark, f"{root}/{version}/segments.json") is None:
        return spark.read.parquet(f"{root}/{version}/{table}")
    from quern.operators.bookindex import BookIndex

    index = BookIndex(spark, root)
    if table == "vectors":
        return index.tables.read("nodes").where("vector is not null").select("node_id", "vector")
    return index.nodes if table == "nodes" else index.tables.read(table).drop("bucket")


def meta(spark: SparkSession, root: str) -> dict:
    return json.loads(read_text(spark, f"{root}/{current(spark, root)}/meta.json") or "{}")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "book_id") -> DataFrame:
    """The new rows, and the old ones of books (or other keys) that have no new rows."""
    return old.join(new.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*new.columns)


def nodes_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Nodes from JSON lines; only node_id, book_id and level must be there, the rest has defaults, metadata keys become columns."""
    fields = [f.strip().split(" ", 1) for f in NODES.split(", ")]
    given = F.from_json(F.col(column), NODES + ", metadata struct<rune_density:double,image_count:int,chunk_index:int,token_count:int,alpha_char_count:int,char_count:int,chunk_quality:double,image_path:string,image_id:string,image_quality:double>")
    inner = {"rune_density", "image_count", "chunk_index", "token_count", "alpha_char_count", "char_count", "chunk_quality", "image_path", "image_id", "image_quality"}
    defaults = {"title": F.lit(""), "text": F.lit(""), "page_from": F.lit(1), "page_to": F.lit(1), "image_ids": F.array().cast("array<string>")}
    rows = lines.select(given.alias("n"))
    checked = rows.where(F.assert_true(F.col("n.node_id").isNotNull() & F.col("n.book_id").isNotNull() & F.col("n.level").isNotNull(), "a node needs node_id, book_id and level").isNull())
    return checked.select(*[F.coalesce(F.col(f"n.{n}"), *([F.col(f"n.metadata.{n}")] if n in inner else []), *([defaults[n]] if n in defaults else [])).cast(t).alias(n) for n, t in fields])


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def ingest_stats(nodes: DataFrame) -> DataFrame:
    """Each book's nodes by level."""
    levels = ["chapter", "section", "chunk", "image"]
    return nodes.groupBy("book_id").agg(F.count("*").alias("num_nodes"), F.count_if(F.col("level") != "book").alias("num_indexable"), *[F.count_if(F.col("level") == x).alias(f"num_{x}s") for x in levels], F.max("page_to").alias("pages"))
