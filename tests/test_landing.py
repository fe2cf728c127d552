"""Files that land: good ones once, bad ones set aside with the reason, after a restart too."""

import os
import pathlib

from pyspark.sql import functions as F

from quern.operators import store
from quern.operators.bookindex import BookIndex
from quern.streaming.landing import land


def test_landing(spark, tmp_path):
    def decode(content):
        """Pages are parted by form feeds behind the first line."""
        head, _, body = content.partition(b"\n")
        if b"broken" in head:
            raise ValueError("no such thing")
        return head[5:].decode() or None, [p.decode() for p in body.split(b"\x0c")] if body else []

    folder, root, bad = tmp_path / "in", f"file://{tmp_path}/index", f"{tmp_path}/bad"
    folder.mkdir()

    def put(name, content, when=None):
        path = folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
        if when:
            os.utime(path, (when, when))

    def run():
        q = land(spark, str(folder), root, bad, f"{tmp_path}/checkpoint", decode, buckets=2, segment=lambda text: F.array(text)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    def found():
        return {r.book_id: (r.title, r.page_to) for r in store.load(spark, root, "nodes").where("level = 'book'").collect()}

    put("Old Stones.pdf", b"%PDF-Of old stones\nThe first page has words.\x0cThe second page, too.", 1000)
    put("none.pdf", b"")  # no row of any kind
    put("white.pdf", b" \r\n\t")
    put("notes.txt", b"%PDF-\nwords")
    put("fake.pdf", b"GIF89a")
    put("torn.PDF", b"%PDF-broken\nx")
    put("blank.pdf", b"%PDF-title alone\n")
    put("more/Old_Stones.pdf", b"%PDF-Older\nThe same name in another folder.", 500)
    run()
    assert found() == {"old-stones": ("Of old stones", 2)}
    reasons = lambda: {pathlib.Path(r.path).name + ("/more" if "/more/" in r.path else ""): r.reason for r in spark.read.parquet(bad).collect()}
    first = {"white.pdf": "empty", "notes.txt": "type", "fake.pdf": "content", "torn.PDF": "unreadable: ValueError", "blank.pdf": "no pages", "Old_Stones.pdf/more": "repeated"}
    assert reasons() == first
    version = store.current(spark, root)
    run()  # nothing new
    assert store.current(spark, root) == version
    put("rivers.pdf", b"%PDF-\nA river runs by the old mill.")
    put("old-stones.pdf", b"%PDF-Anew\nOne page only, and later.")
    run()  # a stream that was started again
    assert found() == {"old-stones": ("Anew", 1), "rivers": ("rivers", 1)} and reasons() == first
    newest = max(pathlib.Path(tmp_path, "checkpoint", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    for crc in newest.parent.glob(f".{newest.name}.crc"):
        crc.unlink()
    version = store.current(spark, root)
    run()  # the last batch again
    assert store.current(spark, root) == version and reasons() == first
    assert {r.book_id: r.n for r in BookIndex(spark, root).tables.raw("books").groupBy("book_id").agg(F.count("*").alias("n")).collect()} == {"old-stones": 2, "rivers": 1}
