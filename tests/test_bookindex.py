"""The stored index: equal to one built at once, batches that write their books alone, compaction, replay."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import vectors as V
from quern.operators import rank, store, tree
from quern.operators.bm25 import Bm25
from quern.operators.bookindex import BookIndex
from quern.plans import service
from quern.streaming.ingest import ingest

BOOKS = "book_id string, title string"
TOPICS = ["stones beside the old harbour wall", "rivers and the mills along their water", "letters of an extinct script", "boats that the people built there"]


def opened(spark, root, embed=V.hash_embedding, **options):
    """Sections are chunks, which plans faster than the rules."""
    return BookIndex(spark, root, embed, segment=lambda text: F.array(text), **options)


def page(book, n, words=""):
    topic = TOPICS[(ord(book[-1]) + n) % 4]
    return (book, n, f"I. Chapter {n}\nThe page of {book} tells of {topic}, and of the year {n}. {words} the the the", [], [])


def library(spark, names, words=""):
    pages = spark.createDataFrame([page(b, n, words) for b in names for n in (1, 2)], tree.PAGES)
    return spark.createDataFrame([(b, f"Book {b}") for b in names], BOOKS), pages


def asked(spark):
    return spark.createDataFrame([(1, "stones harbour the"), (2, "an extinct script of letters"), (3, "nothing xyzzy"), (4, "water water boats new")], "query_id bigint, query string")


def scores(index, queries):
    return sorted((r.query_id, r.node_id, round(r.dense_raw, 6), round(r.sparse_raw, 6)) for r in index.scored(queries).collect())


def written_bytes(root, version):
    return sum(os.path.getsize(p) for p in pathlib.Path(root, version).rglob("*.parquet"))


def test_equals_a_fresh_build(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    index = opened(spark, root, buckets=4)
    assert not index.exists
    index.upsert(*library(spark, ["b1", "b2", "b3"]))
    index.upsert(*library(spark, ["b2", "b4"], "A new word or two."))
    got = index.upsert(*library(spark, ["b5"]))
    assert (got["books"], got["book_nodes"]) == (1, index.tables.read("nodes").where("book_id = 'b5'").count())
    index.remove(spark.createDataFrame([("b3",), ("none",)], "book_id string"))
    books, pages = library(spark, ["b1", "b5"])
    more, new = library(spark, ["b2", "b4"], "A new word or two.")
    fresh = rank.HybridIndex(tree.build(pages.unionByName(new), books.unionByName(more), segment=lambda text: F.array(text)))
    queries, stored = asked(spark), opened(spark, root)
    assert scores(stored, queries) == scores(fresh, queries)
    assert sorted(r.node_id for r in stored.nodes.collect()) == sorted(r.node_id for r in fresh.nodes.collect())
    key = lambda r: (r.query_id, r.place, r.node_id, r.path, round(r.score, 6))
    assert sorted(map(key, rank.retrieve(stored, queries).collect())) == sorted(map(key, rank.retrieve(fresh, queries).collect()))
    # the stored frequencies are those of the texts
    texts = index.indexed.select("node_id", "index_text")
    df = {r.term: r.df for r in Bm25(texts, "node_id", "index_text").terms.collect()}
    assert {r.term: r.change for r in index.tables.read("terms").collect()} == df
    assert index.tables.totals == {"nodes": fresh.nodes.count(), "indexable": texts.count(), "length": Bm25(texts, "node_id", "index_text").docs.agg(F.sum(F.size("tokens"))).first()[0]}
    assert store.load(spark, root, "vectors").count() == texts.count() and store.meta(spark, root)["num_nodes"] == fresh.nodes.count()


def test_a_query_touches_no_document(spark, tmp_path):
    """Only queries are embedded and tokenised."""
    seen = spark.sparkContext.accumulator(0)
    index = opened(spark, f"file://{tmp_path}/i", buckets=4)
    index.upsert(*library(spark, ["b1", "b2", "b3"]))

    def counting(text):
        from pyspark.sql.types import ArrayType, FloatType

        @F.pandas_udf(ArrayType(FloatType()))
        def embed(texts):
            seen.add(len(texts))
            return V.hash_embedding.func(texts)

        return embed(text)

    asking = opened(spark, f"file://{tmp_path}/i", counting, buckets=4)
    queries = asked(spark)
    pairs = queries.select("query_id").crossJoin(asking.indexed.select("node_id"))
    assert len(asking.scored(queries, pairs).collect()) == 4 * asking.tables.totals["indexable"]
    assert seen.value == 4


def test_batches_write_their_books_alone(spark, tmp_path):
    sizes = []
    for name, others in (("small", 1), ("large", 30)):
        index = opened(spark, f"file://{tmp_path}/{name}", buckets=8)
        index.upsert(*library(spark, [f"o{i}" for i in range(others)]))
        before = {p: p.stat().st_mtime_ns for p in pathlib.Path(tmp_path, name).rglob("*.parquet")}
        sizes.append(written_bytes(f"{tmp_path}/{name}", index.upsert(*library(spark, ["new"]))["version"]))
        again = written_bytes(f"{tmp_path}/{name}", index.upsert(*library(spark, ["new"], "and other words"))["version"])
        assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # no file of the others is written
        touched = {p.parent.name for p in pathlib.Path(tmp_path, name, index.tables.version).rglob("*.parquet")}
        assert len(touched) == 1 and again < 3 * sizes[-1]
    assert sizes[1] <= 1.1 * sizes[0]


def test_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    index, queries = opened(spark, root, buckets=2), asked(spark)
    for i in range(2):
        index.upsert(*library(spark, [f"b{i}", "b7", "hot"], f"round {i}"))
    index.remove(spark.createDataFrame([("b1",)], "book_id string"))
    before, totals, nodes = scores(index, queries), index.tables.totals, sorted(r.node_id for r in index.nodes.collect())
    assert index.compact(most=1) == {0, 1} and not index.tables.crowded(1)
    assert len(index.tables.manifest["segments"]) == 1 and index.tables.manifest["masked"] == 0
    assert (scores(index, queries), index.tables.totals, sorted(r.node_id for r in index.nodes.collect())) == (before, totals, nodes)


def test_crowded_buckets_are_merged_by_themselves(spark, tmp_path, monkeypatch):
    from quern.operators import segments

    monkeypatch.setattr(segments.Segments.crowded, "__defaults__", (1,))
    monkeypatch.setattr(BookIndex.compact, "__defaults__", (1,))
    index = opened(spark, f"file://{tmp_path}/i", buckets=1)
    for i in range(2):
        index.upsert(*library(spark, ["b1"], f"round {i}"))
    assert len(index.tables.manifest["segments"]) == 1 and index.nodes.select("book_id").distinct().count() == 1


def test_writers_that_were_overtaken(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    opened(spark, root, buckets=2).upsert(*library(spark, ["b1"]))
    late, first = opened(spark, root), opened(spark, root)
    first.upsert(*library(spark, ["b2"]))
    with pytest.raises(RuntimeError):
        late.upsert(*library(spark, ["b3"]))
    assert {r.book_id for r in opened(spark, root).tables.read("books").collect()} == {"b1", "b2"}
    late.tables.refresh()
    late.upsert(*library(spark, ["b3"]))
    assert {r.book_id for r in opened(spark, root).tables.read("books").collect()} == {"b1", "b2", "b3"}


def test_books_without_text(spark, tmp_path):
    index = opened(spark, f"file://{tmp_path}/i", buckets=2)
    books = spark.createDataFrame([("e", None), ("f", "F")], BOOKS)
    index.upsert(books, spark.createDataFrame([("e", 1, None, None, None), ("x", 1, "no such book", [], [])], tree.PAGES))
    assert {r.node_id for r in index.nodes.collect()} == {"e:book", "e:chapter:1", "f:book", "f:chapter:1"}
    assert index.scored(asked(spark)).count() == 8 and index.sparse(asked(spark)).count() == 0
    index.remove(spark.createDataFrame([("e",), ("f",)], "book_id string"))
    assert index.tables.totals == {"nodes": 0, "indexable": 0, "length": 0} and index.scored(asked(spark)).count() == 0


def test_service(spark, tmp_path):
    r = service.Retrieval(spark, Settings.load(env={}), f"file://{tmp_path}/index")
    out = r.ingest(*library(spark, ["b1", "b2"]))
    assert out["status"] == "ok" and out["books"] == 2 and r.health()["indexable_nodes"] == out["indexable_nodes"] == out["total_nodes"] - 2
    assert r.remove(spark.createDataFrame([("b1",)], "book_id string"))["total_nodes"] < out["total_nodes"]
    assert r.rebuild(*library(spark, ["b3"]))["total_nodes"] == out["total_nodes"] // 2
    assert {x.book_id for x in store.load(spark, r.root, "nodes").collect()} == {"b3"}
    service.EMBEDDERS["other"] = service.EMBEDDERS["blake2b"]
    with pytest.raises(RuntimeError):
        service.Retrieval(spark, Settings.load(env={}), r.root, "other").query(asked(spark))
    del service.EMBEDDERS["other"]


def test_replayed_batches(spark, tmp_path):
    """The same batch again, as after a driver that died between the index's commit and the stream's."""
    arrive, root = f"{tmp_path}/in", f"file://{tmp_path}/index"
    schema = "book_id string, title string, page_num int, text string, image_ids array<string>, ocr_texts array<string>"

    def put(*rows):
        spark.createDataFrame([(b, "T", n, t, [], []) for b, n, t in rows], schema).coalesce(1).write.mode("append").parquet(arrive)

    def run():
        q = ingest(spark.readStream.schema(schema).parquet(arrive), root, f"{tmp_path}/checkpoint", buckets=4).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    put(("a", 1, "A page of a book that has some words to say."), ("b", 1, "Another book, which no later batch will touch."))
    run()
    put(("a", 2, "The second page of the book, in a second batch."))
    run()
    version = store.current(spark, root)
    newest = max(pathlib.Path(tmp_path, "checkpoint", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()  # the stream does not know that its last batch was done
    for crc in newest.parent.glob(f".{newest.name}.crc"):
        crc.unlink()
    run()
    assert store.current(spark, root) == version and store.load(spark, root, "pages").count() == 3
    kept = {r.book_id: r.n for r in BookIndex(spark, root).tables.raw("books").groupBy("book_id").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 2, "b": 1}  # b was written once
