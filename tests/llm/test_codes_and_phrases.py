"""Collocations, SimHash and vector codes against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, simhash, vectorcode
from quern.llm import textkernel as tk

DOCS = "doc_id bigint, text string, lang string, key string, phrase string, fp bigint, n bigint"


def documents(spark, rows):
    """(text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, "x", "y", 1, 2) for i, (t, g) in enumerate(rows)], DOCS)


def phrase_rows():
    random.seed(5)
    common = ["new york", "in the end of", "machine  learning model", "a\tb"]
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        body = [random.choice(words) for _ in range(40)]
        for c in random.sample(common, 2) * 2:
            body.insert(random.randrange(len(body)), random.choice([c, c.upper(), c + random.choice(".,;:!?\n\x0b")]))
        rows.append((" ".join(body), random.choice(["en", None, "und", "tab\tlang", ""])))
    return rows + [rows[0]] * 30 + [(None, "en"), ("", None), (" .,; ", "en"), ("word " * 5000, "en"), ("x y z. " * 200, "long"), ("alone", "none")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # many chunks, few bits, small inserts
        for name, value in (("CHUNK", 300), ("FILTER_BITS", 7), ("INSERT_ROWS", 50), ("BUCKET_WORDS", 500), ("HELD_PIECES", 3), ("TOP_SALTS", 3)):
            monkeypatch.setattr(collocations, name, value)
        monkeypatch.setattr(tk, "HOT_KEYS", 2)
    rows = phrase_rows()
    for least, top in ((20, 2000), (8, 7)):
        got = sorted(map(tuple, collocations.mine(documents(spark, rows), least=least, top=top).collect()))
        assert got == collocations.brute([(g, t) for t, g in rows], least=least, top=top)
    assert len({r[0] for r in got}) >= 5


def test_collocations_of_nothing(spark):
    assert collocations.mine(documents(spark, [("a b", "en")]).limit(0)).count() == 0
    assert collocations.mine(documents(spark, [(None, None), ("", "en"), ("one", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    """a * n and l * r of some 10**24."""
    rows = spark.createDataFrame([(10**12, 3 * 10**12, 2 * 10**12, 10**12 + 1)], "a bigint, n bigint, l bigint, r bigint")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    got = rows.select(((1000 * F.col("a")).cast("decimal(18,0)") * wide("n")).alias("top"), (wide("l") * wide("r")).alias("under")).select(F.expr("top div under")).first()[0]
    assert got == 1000 * 10**12 * 3 * 10**12 // (2 * 10**12 * (10**12 + 1))


def near_texts():
    random.seed(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [random.choice(words) for _ in range(random.choice([1, 2, 3, 30, 200]))]
        for _ in range(random.randint(1, 6)):
            copy = list(base)
            for _ in range(random.randint(0, 1 + len(base) // 60)):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy) if random.random() < 0.7 else "\n".join(copy).upper())
    long = [random.choice(words) for _ in range(3000)]
    for i in range(80):  # a family whose members drift away
        long[random.randrange(3000)] = f"t{i}"
        texts.append(" ".join(long))
    return texts + [texts[0]] * 20 + [None, "", " \t\n", None, "é ü\x0bÄ", "a b", "A  B"]


@pytest.mark.parametrize("small", [False, True])
def test_simhash(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 3), ("SMALL", 4), ("HASHES", 7)):
            monkeypatch.setattr(simhash, name, value)
        monkeypatch.setattr(tk, "HOT_KEYS", 2)
    texts = near_texts()
    got = {r.id: (f"{r.fp & (2**64 - 1):016x}", r.component) for r in simhash.join(documents(spark, [(t, "en") for t in texts])).collect()}
    assert got == simhash.brute(dict(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len({f for f, _ in got.values()}) < len(texts)


def test_simhash_links_of_every_kind():
    """Flips of up to three bits anywhere meet at an anchor; a fingerprint has at most 32 anchors."""
    random.seed(1)
    for _ in range(3000):
        x = random.getrandbits(64)
        y = x
        for b in random.sample(range(64), random.randint(0, 3)):
            y ^= 1 << b
        a, b = (set(simhash.replicas(np.array([z], np.uint64))[0].tolist()) for z in (x, y))
        assert a & b and len(a) <= 32


def test_simhash_odd_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four"), (7, "one two three four"), (7, "one two three four"), (None, "other words than those there"), (9, None), (4, "")], "doc_id bigint, text string")
    got = sorted(((r.id, r.component) for r in simhash.join(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (9, 4), (4, 4)], key=str)
    assert simhash.join(docs.limit(0)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, id string, n long"


def vector_rows(n=300, length=32):
    random.seed(9)
    centres = [[random.uniform(-0.2, 0.2) for _ in range(length)] for _ in range(8)]
    rows = [(i, [random.choice([round(x, 1), x + random.gauss(0, 0.01), 0.0]) for x in random.choice(centres)], random.choice([1, 2, None])) for i in range(n)]
    return rows + [(3, rows[5][1], 1), (3, rows[5][1], 1), (n + 5, None, 1), (n + 6, [None] * length, 2), (n + 7, [float("nan")] * length, 2), (n + 8, [float("inf")] + [0.0] * (length - 1), 2), (n + 9, [], 1), (n + 10, [0.5] * 16, 1), (None, [0.25] * length, None), (n + 11, [-0.0] * length, None)]


@pytest.mark.parametrize("entries", [1, 5, 64])
def test_vector_codes(spark, monkeypatch, entries):
    monkeypatch.setattr(vectorcode, "BLOCK_ROWS", 37)
    rows = vector_rows()
    table = spark.createDataFrame([(i, v, g, "c", "d", 1) for i, v, g in rows], VECTORS).repartition(5)
    codes = vectorcode.compress(table, entries=entries, rounds=3, label_col="label")
    got = sorted(((r.id, r.code.hex(), r.error, r.label) for r in codes.rows.collect()), key=str)
    f32 = lambda x: float(np.float32(x))
    kept = [(i, [int(np.floor(256 * f32(x))) for x in v], g) for i, v, g in rows if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    expected, errors, books = vectorcode.brute([v for _, v, _ in kept], entries=entries, rounds=3)
    assert got == sorted(((i, bytes(c).hex(), e, None if g is None else str(g)) for (i, _, g), c, e in zip(kept, expected, errors, strict=True)), key=str)
    assert codes.codebooks.tolist() == books
    assert codes.scans[0] == 16 * len(kept) and (entries == 1 or codes.scans[-1] < codes.scans[0])  # bounds save scans
    sums = {r.label: r.label_error for r in vectorcode.with_label_errors(codes).collect()}
    assert sums == {g: sum(e for (_, _, x), e in zip(kept, errors, strict=True) if (None if x is None else str(x)) == g) for g in sums} and None in sums
    first = codes.rows.select("id", vectorcode.decoded(F.col("code"), codes.codebooks).alias("v"), "code").where("id = 0").first()
    assert first.v == [x for p, c in enumerate(first.code) for x in books[p][c]]


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, 1, "c", "d", 1), (2, [None], 1, "c", "d", 1), (3, [1.0] * 3, 1, "c", "d", 1)], VECTORS)
    for table in (empty, empty.limit(0)):
        codes = vectorcode.compress(table, label_col="label")
        assert vectorcode.with_label_errors(codes).count() == 0 and codes.rows.columns == ["id", "label", "code", "error"]


def test_bounds_are_outward():
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**28), 2**28, (500, 4))
    book = rng.integers(-(2**28), 2**28, (6, 4))
    at, near, second = vectorcode._scan(x, book)
    exact = np.sort(np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(u, c, strict=True)) for c in book] for u in x], object), axis=1)
    assert (exact[:, 0] == near).all() and (exact[:, 1] == second).all()
    high, low = vectorcode._above(np.sqrt(near)), vectorcode._below(np.sqrt(second))
    assert all(int(h) ** 2 >= e for h, e in zip(high.astype(np.float64), exact[:, 0], strict=True)) and all(int(v) ** 2 <= e for v, e in zip(low.astype(np.float64), exact[:, 1], strict=True))
