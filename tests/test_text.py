import pytest
from pyspark.sql import functions as F

from quern.functions import chunks as C
from quern.functions import responses as R
from quern.functions import text as T

REJECTED = [
    "CE) in the Carpathian Basin in the 10th century by the Hungarians, Kavars (Khazar subjects rebelled against the", "3. Unicode Character Properties ......… 8", "4 Vásáry, 2003; Erdélyi, 2004, p. 76", "L2/11-089", "X nªb ÿx", "I. M",
    "1. Has this proposal for addition been submitted before?", "1. /", "2. У", "1xx00; b KHAZARIAN ROVAS LETTER ANGLED B",
]
ACCEPTED = [
    ("I. Introduction", 1, "Introduction"), ("C. Technical – Justification", 2, "C. Technical – Justification"),
    ("6. The context of use for the proposed characters (type of use; common or rare)", 2, "The context of use for the proposed characters (type of use; common or rare)"),
    ("KHAZARIAN ROVAS", 2, "KHAZARIAN ROVAS"), ("3. Unicode Character Properties", 1, "Unicode Character Properties"),
]


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_headings(spark):
    assert values(spark, REJECTED, T.heading(F.col("s"))) == [(None,)] * len(REJECTED)
    found = values(spark, [x[0] for x in ACCEPTED], T.heading(F.col("s")).alias("h"))
    assert [(h.level, h.title) for (h,) in found] == [x[1:] for x in ACCEPTED]


def test_noise_and_ocr(spark):
    lines = ["Proposal for encoding the Khazarian Rovas script in the SMP - 2 / 19", "2 / 19", "", "plain text", "1 / 2 x"]
    assert [x for (x,) in values(spark, lines, T.is_page_noise(F.col("s")))] == [True, True, True, False, False]
    assert [x for (x,) in values(spark, ["```\n```", "```\nRune text\n```"], T.ocr_clean(F.col("s")))] == ["", "Rune text"]


def test_unicode_white_space_and_names(spark):
    assert values(spark, ["\x1ca  b\x85 c　"], T.collapse(F.col("s"))) == [("a b c",)]
    assert [x for (x,) in values(spark, ["Éa B!", "Руны", None], T.slug(F.col("s")))] == ["ea-b", "book", "book"]
    assert values(spark, ["x/a b?.PDF", "dir/Книга.pdf"], T.file_name(F.col("s")))[0] == ("a_b_.PDF",)
    assert values(spark, ["a/b c", "__"], T.safe_name(F.col("s"))) == [("a_b_c",), ("sample",)]


@pytest.mark.parametrize("size,overlap", [(1200, 180), (170, 0), (60, 20), (9, 4)])
def test_chunks_bound_and_cover(spark, size, overlap):
    texts = ["One. Two words here! Three? " * 30, "w" * 100 + " short words follow. And more.", "", "   ", "line one\nline two ends.\nFigure 2-1 shows\nit-\nself again\n\nlast"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", C.semantic_chunks(F.col("s"), size, overlap).alias("c"))
    for s, c in df.collect():
        assert all(0 < len(x) <= size for x in c), (size, c)
        if overlap == 0:
            assert "".join("".join(c).split()) == "".join(s.replace("it-\nself", "itself").split())
        assert bool(c) == bool(s.strip())


def test_blocks_are_kept(spark):
    text = "The inscription was found on a stone near the river bank.\nFigure 2-1. The stone\nWritten in old letters of the north.\nIPA phonetic transcription: abc\nTranslation from Ogur: the words of a king are here."
    ((c,),) = values(spark, [text], C.semantic_chunks(F.col("s"), 170, 0))
    assert len(c) >= 2 and all(len(x) <= 170 for x in c) and "Figure 2-1" in " ".join(c) and "Translation from Ogur" in " ".join(c)


def test_coverage(spark):
    source = "Alpha sentence. Beta sentence. Gamma sentence."
    df = spark.createDataFrame([(source, ["Alpha sentence. Beta sentence.", "Gamma sentence."]), (source, ["Summary of alpha beta gamma."]), (source, ["Alpha sentence."]), ("", [])], "s string, c array<string>")
    assert [x for (x,) in df.select(C.covers(F.col("s"), F.col("c"), 0)).collect()] == [True, False, False, False]


def test_chat_messages_and_placeholders(spark):
    raw = ['{"choices":[{"message":{"content":" hi "}}]}', '{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}', "{}", "no json"]
    assert [x for (x,) in values(spark, raw, R.message(F.col("s")))] == ["hi", "a\nb", "", ""]
    df = spark.createDataFrame([(["chunk text 1", "abc"],), (["a real passage of text"],), ([],)], "c array<string>")
    assert [x for (x,) in df.select(R.is_placeholder(F.col("c"))).collect()] == [True, False, True]


def test_long_texts_take_linear_time(spark):
    """Four times the text, well under four times four the time: states of the folds hold no texts."""
    import time


    def took(text, f):
        rows = spark.createDataFrame([(text,)], "text string").cache()
        rows.count()
        best = []
        for _ in range(2):
            began = time.time()
            rows.select(f(F.col("text")).alias("c")).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        return min(best)

    for line in ("Some words stand here in a line that ends well.\n", "some words without a stop "):
        f = C.semantic_chunks
        assert took(line * 40_000, f) < 8 * took(line * 10_000, f)
    chunks = spark.createDataFrame([("x y " * 30_000,)], "text string").select(C.split_text(F.col("text"), 100, 20).alias("c")).first().c
    assert max(map(len, chunks)) <= 121 and {w for c in chunks for w in c.split()} == {"x", "y"} and sum(c.count("x") for c in chunks) >= 30_000
