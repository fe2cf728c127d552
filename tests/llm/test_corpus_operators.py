"""Operators on the corpus as a whole, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, graph, jaccard, mixing, ngramlm, quality, sstable
from quern.llm import textkernel as tk

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.choice([3, 5, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 4)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy).upper() if random.random() < 0.3 else " ".join(copy))
    chain = [random.choice(words) for _ in range(100)]
    for i in range(60):  # neighbours link, ends do not; a long column of rows
        copy = chain[i // 2 :] + [f"t{i // 2}-{j}" for j in range(i // 2)]
        texts.append(" ".join(copy))
    return texts + [texts[0]] * 40 + [None, "", "  ", "a", "A", "a b", "b a"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # many blocks, long columns, little memory
        for name, value in (("BLOCK_DOCS", 4), ("BLOCK_GRAMS", 300), ("SHORT", 3), ("COLUMNS", 16), ("FILTER_BITS", 8)):
            monkeypatch.setattr(jaccard, name, value)
    texts = corpus()
    docs = frame(spark, texts).withColumn("component", F.lit("x")).withColumn("key", F.lit(1)).withColumn("word", F.lit(2))
    got = {r.id: (r.n_grams, r.component, r.n_links) for r in jaccard.join(docs).collect()}
    assert got == jaccard.brute(dict(enumerate(texts)))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got.values()})


def test_jaccard_of_common_passages(spark, monkeypatch):
    """Texts that share passages only, in columns that the sketch cannot tell from rare ones, do not all meet in products; rounds of products find all links."""
    for name, value in (("BLOCK_DOCS", 8), ("SHORT", 2), ("SKETCH_BITS", 2), ("SKETCH_PART", 4), ("ROUND_GRAMS", 100), ("TRIES", 5), ("WIDE", 1)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    placed, edges, cut = [], [], tk.cut

    def seen(df, purpose):
        out = cut(df, purpose)
        if purpose == "jaccard-placed":
            placed.append(out.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("wanted")).first())
        edges.extend([purpose] if purpose == "jaccard-edges" else [])
        return out

    monkeypatch.setattr(tk, "cut", seen)
    random.seed(6)
    passages = [" ".join(f"p{i}-{j}" for j in range(9)) for i in range(2)]
    texts = [" ".join([*(f"w{random.randrange(10**6)}" for _ in range(26)), passages[i % 2]]) for i in range(120)]
    texts += [t + " tail" for t in texts[:3]]
    got = {r.id: (r.n_grams, r.component, r.n_links) for r in jaccard.join(frame(spark, texts)).collect()}
    assert got == jaccard.brute(dict(enumerate(texts)))
    assert placed[-1].wanted <= 2 * len(texts)
    family = [" ".join([*(f"f{j}" for j in range(60)), f"x{i}"]) for i in range(40)]  # all link
    edges.clear()
    got = {r.id: (r.n_grams, r.component, r.n_links) for r in jaccard.join(frame(spark, family)).collect()}
    assert got == jaccard.brute(dict(enumerate(family)))
    assert placed[-1].wanted > 3 * placed[-1].n and len(edges) > 2


def test_jaccard_odd_ids(spark):
    texts = ["one two three four five six"] * 3 + ["seven eight"] + [None, "seven eight"]
    docs = frame(spark, texts, [5, 5, None, None, 9, 3])
    got = sorted(((r.id, r.n_grams, r.component) for r in jaccard.join(docs).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, 3), (9, 0, 9), (3, 1, 3)], key=str)
    assert jaccard.join(docs.limit(0)).count() == 0
    assert jaccard.join(frame(spark, [None, ""])).count() == 2


def test_jaccard_keep_one_of_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, long)] * 30 + [(5, long + " tail"), (7, long)]  # one id: exact copies and a linked text
    rows += [(None, "a b c d e f")] * 20 + [(None, "A b c d e f")]  # no id at all
    rows += [(5, other), (5, other), (9, other)]  # another component of the same smallest id
    rows += [(None, "g h i j k l m"), (4, "g h i j k l m"), (8, "alone here"), (8, None), (8, None)]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = jaccard.keep_one(docs)
    got = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    assert kept.columns == docs.columns
    tail = [x for x in got if x[0] == 5 and x[1].startswith("w0 ")]
    assert len(tail) == 1 and tail[0][1] in (long, long + " tail")
    rest = [x for x in got if x not in tail]
    assert sorted(rest, key=str) == sorted([(None, "a b c d e f"), (5, other), (4, "g h i j k l m"), (8, "alone here"), (8, ""), (8, "")], key=str)


def test_product():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 20)).astype(np.uint64) for _ in range(9)]
    plain = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    o = jaccard.product(sets, None)
    off = ~np.eye(9, dtype=bool)
    assert (o[off] == np.array(plain)[off]).all()
    assert (jaccard.product(sets[:4], sets[4:]) == np.array(plain)[:4, 4:]).all()


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(4), "t").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint"), "t").count() == 0


@pytest.mark.parametrize("order,tokens", [(2, 2_000_000), (3, 40)])
def test_language_model(spark, monkeypatch, order, tokens):
    monkeypatch.setattr(ngramlm, "RANGE_TOKENS", tokens)
    texts = [t for t in corpus() if t is None or len(t) < 300][:60] + ["new words", "w1 w2 W3"]
    docs = frame(spark, texts).withColumn("score", F.lit("clash"))
    model = ngramlm.train(docs.where(~ngramlm.held_out()), order)
    rows = {r.id: r for r in ngramlm.score(docs, model).collect()}
    split = lambda t: [w for w in (t or "").encode().lower().split()] + [0]
    counts = [None] + [Counter() for _ in range(order)]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = split(t)
            for k in range(1, order + 1):
                counts[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    total, kinds = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (counts[1][g] + 0.5) / (n + 0.5 * (v + 1))
        low, c = p(g[1:]), g[:-1]
        return low if not total[c] else max(counts[len(g)][g] - ngramlm.DISCOUNT, 0) / total[c] + ngramlm.DISCOUNT * kinds[c] / total[c] * low

    assert model.total == n and model.size == v
    for i, t in enumerate(texts):
        w = split(t)
        assert rows[i].n_tokens == len(w) and rows[i].n_known == sum(counts[1][(x,)] > 0 for x in w)
        assert abs(rows[i].base_score - sum(math.log10(p((x,))) for x in w)) < 1e-9
        exact = [math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(len(w))]
        assert abs(rows[i].score - sum(exact)) <= len(w) * order * 0.03  # probabilities are bytes
    assert ngramlm.score(docs.limit(0), model).count() == 0


def test_language_model_uses_longer_contexts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ngramlm, "RANGE_TOKENS", 60)
    random.seed(4)
    docs = frame(spark, [f"a b {'c' if i % 2 else random.choice('defgh') + str(i)}" for i in range(300)] + ["b d0 e", "x b c"])
    model = ngramlm.train(docs, 3)
    tokens = model.masses[1]
    kinds = [s[2] for s in model.levels[1]]
    assert max(kinds) < 0.5 * sum(kinds) and max(tokens) < 0.75 * sum(tokens)  # the context 'a b' is cut by its words
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in ngramlm.query(spark, str(tmp_path)).collect()}
    kept = docs.where(~ngramlm.held_out())
    three = {r.id: r.score for r in ngramlm.score(docs, ngramlm.train(kept, 3)).collect()}
    two = {r.id: r.score for r in ngramlm.score(docs, ngramlm.train(kept, 2)).collect()}
    assert got == three != two


def test_language_model_of_nothing(spark):
    docs = frame(spark, ["a b"])
    model = ngramlm.train(docs.limit(0))
    r = ngramlm.score(docs, model).first()
    assert (model.total, r.n_tokens, r.n_known) == (0, 3, 0)


def test_tokens_are_looked_up_together(spark, monkeypatch):
    """A shard is searched once for the tokens of many texts, however few lie in an Arrow batch; rows don't depend on how many that are."""
    monkeypatch.setattr(ngramlm, "RANGE_TOKENS", 300)
    random.seed(8)
    texts = [" ".join(random.choices([f"w{i}" for i in range(60)], k=random.randint(0, 30))) for _ in range(300)] + [None, ""]
    docs = frame(spark, texts).coalesce(1)
    model = ngramlm.train(docs, 3)
    calls = []
    kept = ngramlm.successor
    monkeypatch.setattr(ngramlm, "successor", lambda *args: calls.append(1) or kept(*args))
    batches = pa.Table.from_pandas(docs.toPandas()).to_batches(10)
    number, rows = [], []
    for most in (600_000, 100):
        monkeypatch.setattr(ngramlm, "AT_ONCE", most)
        calls.clear()
        walk = ngramlm.Walk(model)
        rows.append([])
        for h, first, ids in ngramlm.gathered(iter(batches), batches[0].schema.get_field_index("text")):
            _, _, _, counts, p = walk(h, first)
            rows[-1] += zip(pa.concat_arrays(ids).to_pylist(), np.diff(first).tolist(), np.add.reduceat(p, first[:-1]).tolist(), strict=True)
        number.append(len(calls))
    assert number[0] <= sum(len(x) for x in model.levels) < number[1] and len(model.levels[0]) > 3
    assert rows[0] == rows[1] and [r[0] for r in rows[0]] == list(range(len(texts)))


def test_integers_in_order():
    rng = np.random.default_rng(2)
    for n, most in ((0, 5), (1, 5), (1000, 3), (5000, 2**63 - 1), (70_000, 2**60), (70_000, 2**49)):
        keys = rng.integers(0, most, n, dtype=np.uint64)
        for x in (keys, np.concatenate([keys // np.uint64(10**9) * np.uint64(10**9) + rng.integers(0, 3, n, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])):  # the second: few high bits, all 64 in use
            order = ngramlm.ordered(x)
            assert (x[order] == np.sort(x)).all() and (np.sort(order) == np.arange(len(x))).all()
            assert all((a == b).all() for a, b in zip(ngramlm.distinct(x), np.unique(x, return_inverse=True), strict=True))


def test_elias_fano():
    rng = np.random.default_rng(6)
    for n, u in ((1, 10), (70, 100), (5000, 2**40), (3000, 2**63)):
        keys = np.unique(rng.integers(0, u, n, dtype=np.uint64))
        a = ngramlm._keys_arrays(keys)
        assert (ngramlm.find(a, keys) == np.arange(len(keys))).all()
        other = np.setdiff1d(rng.integers(0, u, 2000, dtype=np.uint64), keys)
        assert (ngramlm.find(a, other) == -1).all()
    values = np.sort(rng.integers(0, 10**6, 3000)).astype(np.uint64)
    assert (ngramlm.Pointers(*ngramlm.Pointers.build(values))[np.arange(3000)] == values).all()
    packed = ngramlm.pack(values, 20)
    assert (ngramlm.unpack(packed, np.arange(3000), 20) == values).all() and packed.nbytes < 3000 * 20 / 8 + 32


def test_successors_by_context():
    """Context-relative search against a plain dictionary: uneven words, wide and empty contexts."""
    rng = np.random.default_rng(9)
    for words, n in ((5, 12), (1000, 4000), (10**6, 3000)):
        word = np.where(rng.random(n) < 0.5, rng.integers(0, words, n), rng.integers(0, max(1, words // 100), n))
        key = np.unique(rng.choice([7, 8, 12, 500, 501], n) * words + word)
        a = ngramlm.level_arrays(key // words, key % words, words)
        place = {k: i for i, k in enumerate(key.tolist())}
        asked = np.unique(np.concatenate([key, rng.integers(5 * words, 505 * words, 3000)]))
        assert ngramlm.successor(a, asked // words, asked % words).tolist() == [place.get(k, -1) for k in asked.tolist()]


def named(letter, n):
    return [letter + chr(97 + i // 26) + chr(97 + i % 26) for i in range(n)]


def labelled(spark):
    random.seed(8)
    words = named("v", 300)
    rows, labels = [], []
    for i in range(400):
        kind = i % 10
        text = " ".join(random.choice(words) for _ in range(random.randint(20, 80)))
        if kind == 0:
            text += " nasty vile " * 3
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s", len(text)))
        if i % 2 == 0 or kind == 1 and i % 20 == 1:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_mixing(spark):
    docs, labels = labelled(spark)
    found = mixing.mix(docs, labels).toPandas()
    p, t, r = np.stack(found.p.to_numpy()), found.n_tokens.to_numpy(), found.rate.to_numpy()
    truth = np.where(found.id % 10 == 0, 2, np.where(found.id % 10 == 1, 1, 0))
    held = ~found.id.isin([x.doc_id for x in labels.collect()])
    assert (p[held].argmax(1) == truth[held]).mean() > 0.95  # held-out accuracy
    natural, mixed = p.T @ t, p.T @ (t * r)
    w = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    goal = w * natural[0] / w[0]
    assert (np.abs(mixed - goal) < 0.01 * goal).all() and r.min() >= 0  # each domain by itself
    assert np.allclose(found[[f"target_{d}" for d in mixing.DOMAINS]].iloc[0], goal) and np.allclose(found[[f"reached_{d}" for d in mixing.DOMAINS]].iloc[0], mixed)
    kept = mixing.apply_rates(docs.withColumn("chance", F.lit("clash")), labels)
    ids = {x.doc_id for x in kept.collect()}
    assert kept.columns == [*docs.columns, "chance"] and len([i for i in ids if i % 10 > 1]) >= 0.97 * 320 and len([i for i in ids if i % 10 == 0]) < 30
    # with a bound: a step by step solution of the same problem in one place, by the plain gradient
    bound = mixing.mix(docs, labels, most=1.0).toPandas()
    rb, goal2 = bound.rate.to_numpy(), goal
    rate = np.ones(len(t))
    loss = lambda r: ((p.T @ (t * r) - goal2) ** 2 / natural).sum()
    for _ in range(3000):
        rate = np.clip(rate - 0.5 * p @ ((p.T @ (t * rate) - goal2) / natural), 0, 1)
    assert rb.min() >= 0 and rb.max() <= 1 and loss(rb) <= loss(rate) * 1.1 + 1e-5 * loss(np.ones(len(t)))


def test_mixing_bounded_keeps_clean_documents(spark):
    """Where a domain has too little for its target and rates are bounded, the others are not cut for it."""
    docs, labels = labelled(spark)
    found = mixing.mix(docs.where("doc_id % 10 > 1 or doc_id % 40 = 0"), labels, most=1.0, tolerance=0.01).toPandas()
    assert found.rate[found.id % 10 > 1].min() > 0.97


def test_mixing_scarce_and_repeated(spark):
    """A domain with less than its target has rates above one; of several labels the worst counts, whatever their order."""
    docs, labels = labelled(spark)
    found = mixing.mix(docs, labels, targets={"clean": 0.5, "low": 0.3, "toxic": 0.2}).toPandas()
    p, t, r = np.stack(found.p.to_numpy()), found.n_tokens.to_numpy(), found.rate.to_numpy()
    goal = np.array([0.5, 0.3, 0.2]) * (p.T @ t)[0] / 0.5
    assert (np.abs(p.T @ (t * r) - goal) < 0.01 * goal).all() and r.max() > 1
    copies = mixing.apply_rates(docs, labels, targets={"clean": 0.5, "low": 0.3, "toxic": 0.2})
    assert Counter(x.doc_id % 10 == 0 for x in copies.collect())[True] > 40
    twice = labels.unionByName(labels.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    a, b = (mixing.fit(docs.unionByName(docs).orderBy(*o), twice.orderBy(*o)) for o in ((F.col("doc_id"),), (F.col("doc_id").desc(),)))
    assert (a.words == b.words).all() and np.allclose(a.weight, b.weight) and np.allclose(a.weight, mixing.fit(docs, labels).weight)


def test_mixing_odd_tables(spark):
    docs, labels = labelled(spark)
    odd = docs.limit(2).unionByName(frame(spark, [None, "", "x"], [None, 3, 3]))
    assert mixing.mix(odd, labels.limit(0)).count() == 5
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.apply_rates(odd, labels.where("doc_id is null")).columns == docs.columns


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark)
    long = " ".join(named("q", 80))
    extra = frame(spark, [long, long, long + " tail", "too short", " ".join(named("b", 11) + named("r", 60)), None], [1000, 1001, 1002, 1003, 1004, 1005])
    (docs.unionByName(extra)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(named("b", 10)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token-ID output"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()} if "text" in now.columns else {}
        now = tk.cut(stage(spark, now, str(tmp_path)), "stage")
        ids = {r.doc_id for r in now.collect()}
        seen.append(ids)
        assert ids <= set(before)
        if name != "token-ID output":
            assert now.columns == docs.columns
        if name == "quality rules":
            book = {r.doc_id: r.failed for r in quality.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
            assert ids == {i for i, f in book.items() if f == 0}
        if name == "n-gram Jaccard join":
            assert ids == {c for _, c, _ in jaccard.brute(before).values()} and 1000 in ids and not {1001, 1002} & ids
        if name == "benchmark decontamination":
            assert set(before) - ids == {1004}
    assert seen[-1] == seen[-2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[-1]
    assert sstable.END_ID == 2 and decontaminate.N_WORDS == 10
