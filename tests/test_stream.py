"""Pages that arrive over several batches."""

from quern.operators import store
from quern.streaming.ingest import ingest

PAGES = "book_id string, title string, page_num int, text string, image_ids array<string>, ocr_texts array<string>"


def test_a_book_may_arrive_in_several_batches(spark, tmp_path):
    arrive, root = f"{tmp_path}/in", f"{tmp_path}/index"

    def batch(*rows):
        spark.createDataFrame([(*r, [], []) for r in rows], PAGES).coalesce(1).write.mode("append").parquet(arrive)
        stream = spark.readStream.schema(PAGES).parquet(arrive)
        q = ingest(stream, root, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    def texts():
        return {r.book_id: r.t for r in store.load(spark, root, "nodes").where("level = 'chunk'").groupBy("book_id").agg({"text": "collect_list"}).withColumnRenamed("collect_list(text)", "t").collect()}

    batch(("a", "A", 1, "The first page tells of stones and of the old walls that stood beside them."), ("b", "B", 1, "Another book, of the old harbour, its boats and the people who lived there."))
    batch(("a", "A", 2, "The second page tells of rivers, of bridges and the mills along the water."))
    found = texts()
    assert "stones" in " ".join(found["a"]) and "rivers" in " ".join(found["a"]) and "Another" in " ".join(found["b"])
    batch(("a", "A", 1, "The first page, mended, tells of hills and of the paths that lead up there."), ("a", "A", 3, None))
    found = " ".join(texts()["a"])
    assert "hills" in found and "rivers" in found and "stones" not in found
    assert store.load(spark, root, "pages").count() == 4 and store.current(spark, root)
