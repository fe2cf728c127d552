import pytest
from pyspark.sql import functions as F

from quern.config import Settings, dotenv
from quern.operators import rank, store, tree
from quern.plans import service

IMAGES = "image_id string, book_id string, page_num int, path string, ocr_text string, rune_density double"


def nodes(spark):
    pages = spark.createDataFrame(
        [("b", 1, "TITLE PAGE HERE\nsome body text of the first section that is long enough.", ["i1", "zz"], ["scan"]), ("b", 2, "I. Introduction\nplain words that go on and on until the end.", [], []), ("b", 3, "", ["i2"], []), ("b", 4, "2 / 9", [], []), ("c", 1, None, None, None)], tree.PAGES
    )
    images = spark.createDataFrame([("i1", "b", 1, "/p/i1", "ᚠᚠ", 0.5), ("i2", "b", 3, "/p/i2", "", 0.0)], IMAGES)
    return tree.build(pages, spark.createDataFrame([("b", "Book"), ("c", "Empty")], "book_id string, title string"), images)


def test_build(spark):
    found = {r.node_id: r for r in nodes(spark).collect()}
    assert sorted(found) == sorted(["b:book", "b:chapter:1", "b:section:1", "b:chunk:1", "b:image:1", "b:chapter:2", "b:section:2", "b:chunk:2", "b:image:2", "c:book", "c:chapter:1"])
    assert [found[x].ord for x in ("b:book", "b:chapter:1", "b:section:1", "b:chunk:1", "b:image:1", "b:chapter:2")] == [1, 2, 3, 4, 5, 6]
    assert (found["b:chapter:1"].title, found["b:chapter:1"].page_to, found["b:chapter:2"].page_to) == ("Введение", 2, 4)
    s = found["b:section:1"]
    assert s.title == "TITLE PAGE HERE" and s.text.split("\n")[1:] == ["[OCR] scan", "[IMAGE i1] ᚠᚠ"] and s.image_ids == ["i1", "zz"] and s.rune_density == 0.5
    assert (found["b:section:2"].title, found["b:section:2"].page_from, found["b:section:2"].page_to) == ("Секция стр. 2", 2, 3)
    assert found["b:image:2"].image_quality == 0.2 and found["b:image:2"].text.endswith("без OCR текста")


def test_paths_and_descendants(spark):
    n = nodes(spark)
    path = {r.node_id: r.path for r in tree.with_context(n).collect()}
    assert path["b:chunk:2"] == "Book > Introduction > Секция стр. 2 > Секция стр. 2 / chunk 1"
    assert {r.node_id for r in tree.descendants(n, ["image"]).where("ancestor_id = 'b:book'").collect()} == {"b:image:1", "b:image:2"}


def fixture(spark, rows):
    columns = {"book_id": "b", "image_ids": [], "rune_density": None, "image_count": None, "chunk_index": None, "token_count": None, "alpha_char_count": None, "char_count": None, "chunk_quality": None, "image_path": None, "image_id": None, "image_quality": None}
    names = [f.split()[0] for f in tree.NODES.split(", ")]
    full = [columns | {"node_id": i, "parent_id": p, "level": lv, "ord": k, "title": t, "text": x, "page_from": 1, "page_to": 1} for k, (i, p, lv, t, x) in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], tree.NODES)


ones = lambda text: F.array(*[F.lit(1.0).cast("float")] * 3)
BOOK = ("book", None, "book", "Khazarian Rovas proposal", "")
SUMMARY = ("summary", "book", "chunk", "Summary / chunk 1", "The Khazarian Rovas is an extinct script. It was used by the Khazars. The letters are known.")
CHART = ("code-chart", "book", "chunk", "Code chart of the KHAZARIAN ROVAS in the SMP / chunk 2", "LETTER ARCHED Q 1xx16; R KHAZARIAN ROVAS LETTER; unicode code chart letters")
FORM = ("appendix", "book", "chunk", "Appendix: Proposal Summary Form / A. Administrative / chunk 1", "1. Title: Proposal for encoding the Khazarian Rovas")


def ranked(spark, rows, query):
    index = rank.HybridIndex(fixture(spark, rows), ones)
    asked = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    return [(r.node_id, r.score) for r in rank.top_k(rank.hybrid(index.scored(asked)), 3).orderBy("rank").collect()]


def test_prose_before_forms_and_charts(spark):
    found = ranked(spark, [BOOK, SUMMARY, CHART, FORM], "What is Khazarian Rovas?")
    assert found[0][0] == "summary" and dict(found)["appendix"] < dict(found)["summary"]


def test_charts_first_when_asked_for(spark):
    others = [(f"other{i}", "book", "chunk", f"River {i} / chunk 1", "Stones lie by the river. The wind is cold here.") for i in range(4)]
    assert ranked(spark, [BOOK, SUMMARY, CHART, *others], "Unicode code chart Khazarian Rovas letters")[0][0] == "code-chart"


def test_retrieve_and_answer(spark, tmp_path):
    settings = Settings.load(env={})
    r = service.Retrieval(spark, settings, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "plain words until the end"), (2, "rune letters")], "query_id bigint, query string")
    with pytest.raises(RuntimeError):
        r.query(asked)
    books = spark.createDataFrame([("b", "Book")], "book_id string, title string")
    pages = spark.createDataFrame([("b", 1, "I. Introduction\nplain words that go on and on until the end.", ["i1"], [])], tree.PAGES)
    images = spark.createDataFrame([("i1", "b", 1, "/p/i1", "ᚠᚠ rune letters", 0.5)], IMAGES)
    assert r.ingest(books, pages, images)["total_nodes"] == 6
    assert r.ingest(books, pages, images)["total_nodes"] == 6  # the same book replaces itself
    assert r.health()["index_ready"]
    answers = {x.query_id: x for x in r.query(asked, 8, 4).collect()}
    assert answers[1].answer.startswith(rank.NO_MODEL) and "plain words" in answers[1].answer
    assert "1. [p.1-1] [IMAGE i1]" in answers[2].answer  # an image first for a rune query
    with pytest.raises(ValueError):
        r.query(asked, 41)


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    old = spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, x int")
    v1 = store.save(root, {"nodes": old})
    store.save(root, {"nodes": store.upsert(store.load(spark, root, "nodes"), spark.createDataFrame([("b", 3)], "book_id string, x int"))})
    assert sorted(map(tuple, store.load(spark, root, "nodes").collect())) == [("a", 1), ("b", 3)]
    store.activate(spark, root, v1)
    assert sorted(map(tuple, store.load(spark, root, "nodes").collect())) == [("a", 1), ("b", 2)]
    lines = spark.createDataFrame([('{"node_id":"n","book_id":"b","level":"chunk","metadata":{"chunk_quality":0.5,"odd":1}}',)], "value string")
    n = store.nodes_from_json(lines).first()
    assert (n.title, n.page_from, n.chunk_quality, n.image_ids) == ("", 1, 0.5, [])


def test_settings(tmp_path):
    toml = tmp_path / "s.toml"
    toml.write_text('[params]\nchunk_size = 900\n[paths]\nbooks_dir = "x"\n')
    s = Settings.load(toml, env={"RAG_BOOKS_DIR": "  ", "RAG_CHUNK_OVERLAP": "bad", "RAG_BOOTSTRAP_ON_STARTUP": "Yes"})
    assert (s.chunk_size, s.books_dir, s.chunk_overlap, s.bootstrap_on_startup) == (900, "x", 180, True)
    assert dotenv("# c\nA='1'\nB\nC=\"2\" ") == {"A": "1", "C": "2"}
