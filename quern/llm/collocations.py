"""Phrase collocation mining (11): contiguous phrases that occur more often than their parts would by chance.

1.  Texts become pieces (normalised words between stops).  Equal pieces of a
    language are one row with a multiplicity, first within a task, then by an
    aggregation; all later counts are weighted by it.
2.  Word pairs are counted as 64-bit hashes, a blob for each hash bucket and
    chunk of pieces.  Each bucket is counted by duckdb, which spills to its
    task's own folder.  The pairs that reach the least count fill a bit set of
    fixed size.  A phrase that reaches it has only such pairs, so the set
    leaves out no candidate; what it lets through by chance is counted and goes.
3.  Phrases of one to five words all of whose pairs are in the set are counted
    likewise, but as texts: no count depends on a hash.
4.  A candidate asks for the counts of both parts of each of its cuts.  The
    requests are shuffled to the parts' rows, those for parts that very many
    candidates share are answered by broadcast, and the answers meet by
    candidate.  Each candidate also asks off the candidates that it holds.

Scores are exact: products are decimals of 38 digits, which hold those of any
corpus below 10**15 words.

Defined results: null and empty texts have no words; a null language is
``und``; repeated rows count as often as they stand, whatever their ids; a
language without candidates has no rows; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

MOST_WORDS = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"
HELD_PIECES = 100_000  # distinct pieces, and
HELD_BYTES = 16 << 20  # their bytes, that a task holds before it hands them on
CHUNK = 2 << 20
FILTER_BITS = 26
BUCKET_WORDS = 2_000_000  # words a bucket
DUCKDB_MEMORY = "256MB"
INSERT_ROWS = 1 << 18
TOP_SALTS = 16

_U = np.uint64
_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z folded, every stop a line feed; what then is white within a line is a space or a tab.
_FOLD = bytes(0x0A if b in _STOPS else int(tk.LOWER[b]) for b in range(256))
WORD = np.ones(256, bool)
WORD[0x20] = False


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, times, n_words): the distinct pieces of each language, their words joined by single spaces."""
    tk.modest_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        size = 0

        def out():
            langs, texts = zip(*held, strict=True)
            arrays = [pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([t.count(b" ") + 1 for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "piece", "times", "n_words"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, data, off in tk.chunks(batch.column(1)):
                body = data.tobytes().translate(_FOLD)
                for d in range(hi - lo):
                    lang = langs[lo + d]
                    for line in body[off[d] : off[d + 1]].split(b"\n"):
                        if words := line.split():
                            key = (lang, b" ".join(words))
                            if key in held:
                                held[key] += 1
                            else:
                                held[key] = 1
                                size += len(key[1])
                                if len(held) >= HELD_PIECES or size >= HELD_BYTES:
                                    yield out()
                                    held, size = {}, 0
        if held:
            yield out()
        tk.trim()

    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    found = given.mapInArrow(run, "lang string, piece string, times bigint, n_words bigint")
    return found.groupBy("lang", "piece").agg(F.sum("times").alias("times"), F.first("n_words").alias("n_words"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces in chunks of about CHUNK bytes: the languages; each piece's language and multiplicity; bytes; starts, ends, hashes (with the language) and piece numbers of words."""

    def done(held):
        table = pa.Table.from_batches(held)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        for lo, hi, data, off in tk.chunks(table.column("piece"), 8 * CHUNK):
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()[lo:hi]
            starts, ends, first = tk.spans(WORD[data], off)
            piece = np.repeat(np.arange(hi - lo), np.diff(first))
            salt = np.array([tk.mix(np.array([hash_of(x)], np.uint64))[0] for x in names], np.uint64)
            yield names, lang, table.column("times").to_numpy()[lo:hi], data, starts, ends, tk.span_hash(data, starts, ends, False) ^ salt[lang[piece]], piece

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= CHUNK:
            yield from done(held)
            held, size = [], 0
    if held:
        yield from done(held)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) << 32 | zlib.adler32(text.encode())


def _pairs(words: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs that start at each word, and whether there is one; both one short of the words."""
    return tk.mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]), piece[:-1] == piece[1:]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first place of each, and their weights' sums."""
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, inverse, weights)
    return unique, first, sums


class Counter:
    """Weighted counts of a bucket's keys, out of core: rows wait in a duckdb file in a folder of the task, which goes with it."""

    def __init__(self, keys: dict[str, str]):
        import duckdb

        self.keys = list(keys)
        self.folder = tempfile.TemporaryDirectory(prefix="collocations-")
        self.con = duckdb.connect(f"{self.folder.name}/counts.db", config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": f"{self.folder.name}/spill", "preserve_insertion_order": False})
        self.con.execute(f"create table counts ({', '.join(f'{k} {t}' for k, t in keys.items())}, n bigint)")

    def __enter__(self) -> Counter:
        return self

    def __exit__(self, *_) -> None:
        self.con.close()
        self.folder.cleanup()

    def add(self, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"insert into counts select {', '.join(self.keys)}, n from given")
        self.con.unregister("given")

    def frequent(self, least: int) -> Iterator[pa.RecordBatch]:
        names = ", ".join(self.keys)
        yield from self.con.sql(f"select {names}, sum(n)::bigint as n from counts group by {names} having sum(n) >= {least}").to_arrow_reader(INSERT_ROWS)


def _frequent_pairs(given: DataFrame, least: int, buckets: int) -> np.ndarray:
    """A bit set, by hash, of the word pairs that occur at least so often (and of others, by chance)."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, times, _, _, _, words, piece in _chunks(batches):
            if len(words) < 2:
                continue
            pair, there = _pairs(words, piece)
            pair, _, n = _summed(pair[there], times[piece[:-1][there]])
            bucket = (pair % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            pair, n, bucket = pair[order], n[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
            last = np.append(first[1:], len(bucket))
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *blobs], ["bucket", "pairs", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Counter({"pair": "ubigint"}) as counter:
            held, size = [], 0

            def flush():
                pair = np.concatenate([np.frombuffer(p, np.uint64) for p, _ in held])
                n = np.concatenate([np.frombuffer(c, np.int64) for _, c in held])
                counter.add(pa.table({"pair": pair, "n": n}))

            for batch in batches:
                for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    held.append((p, c))
                    size += len(p) // 8
                    if size >= INSERT_ROWS:
                        flush()
                        held, size = [], 0
            if held:
                flush()
            for batch in counter.frequent(least):
                slot = batch.column(0).to_numpy() >> _U(64 - FILTER_BITS)
                word, first = np.unique(slot >> _U(6), return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, first, _U(1) << (slot & _U(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], ["word", "mask"])

    rows = given.select("lang", "piece", "times").mapInArrow(emitted, "bucket int, pairs binary, counts binary")
    marks = rows.repartitionById(buckets, "bucket").mapInArrow(counted, "word int, mask bigint")
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = tk.cut(marks, "collocation-pairs").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # of fixed size
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of the bytes as texts."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(starts - off[:-1], size) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(data[at].tobytes()))


def phrases(given: DataFrame, pairs: np.ndarray, least: int, buckets: int, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, phrase, words, f): phrases of one to ``most_words`` words, all of whose pairs are in the set, that occur at least so often."""
    shared = given.sparkSession.sparkContext.broadcast(pairs)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for names, lang, times, data, starts, ends, words, piece in _chunks(batches):
            if not len(words):
                continue
            good = np.zeros(len(words), bool)
            pair, there = _pairs(words, piece)
            slot = pair >> _U(64 - FILTER_BITS)
            good[:-1] = there & ((marks[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63)) & _U(1)) == 1)
            at, hashes, run = np.arange(len(words)), words, np.ones(len(words), bool)
            for k in range(1, most_words + 1):
                if k > 1:  # one word more, where the pair that it makes is in the set
                    run = np.concatenate([run[: len(words) - k + 1] & good[k - 2 :][: len(words) - k + 1], np.zeros(k - 1, bool)])
                    at = np.flatnonzero(run)
                    hashes = tk.mix(hashes[: len(hashes) - 1] * _U(0x9E3779B97F4A7C15) + words[k - 1 :])
                if not len(at):
                    break
                key, first, n = _summed(hashes[at], times[piece[at]])
                first = at[first]
                which = lang[piece[first]]
                texts = _slices(data, starts[first], ends[first + k - 1]).cast(pa.string())
                bucket = pa.array((key % _U(buckets)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, pa.array(names, pa.string()).take(pa.array(which)), texts, pa.array([k] * len(first), pa.int32()), pa.array(n)], ["bucket", "lang", "phrase", "words", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Counter({"lang": "varchar", "phrase": "varchar", "words": "integer"}) as counter:
            held, size = [], 0
            for batch in batches:
                held.append(batch.select(["lang", "phrase", "words", "n"]))
                size += batch.num_rows
                if size >= INSERT_ROWS:
                    counter.add(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                counter.add(pa.Table.from_batches(held))
            yield from counter.frequent(least)

    rows = given.select("lang", "piece", "times").mapInArrow(emitted, "bucket int, lang string, phrase string, words int, n bigint")
    return rows.repartitionById(buckets, "bucket").mapInArrow(counted, "lang string, phrase string, words int, f bigint")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _key(phrase: Column) -> Column:
    """A phrase of a language as one text: phrases hold no tab."""
    return F.concat(phrase, F.lit("\t"), F.col("lang"))


def _answered(requests: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """The requests with the count (``name``) of their part; parts that many requests share are answered by broadcast."""
    asked = tk.cut(requests, "collocation-requests")
    copies = asked.groupBy("key").agg(F.count("*").alias("copies"))
    table = tk.cut(copies.join(counts.select(_key(F.col("phrase")).alias("key"), F.col("f").alias(name)), "key"), "collocation-parts")
    return tk.spread_join(asked, table, "key", "copies").drop("key", "copies")


def mine(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of two to ``most_words`` words of each language."""
    spark = docs.sparkSession
    given = tk.cut(pieces(docs, text_col, lang_col), "collocation-pieces")
    totals = tk.cut(given.groupBy("lang").agg(F.sum(F.col("times") * F.col("n_words")).alias("n"), F.sum("n_words").alias("once")), "collocation-totals")
    words = totals.agg(F.sum("once")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET_WORDS))
    pairs = _frequent_pairs(given, least, buckets)
    counts = tk.cut(phrases(given, pairs, least, buckets, most_words), "collocation-counts")

    candidates = counts.where("words >= 2")
    # a longer candidate that is as frequent takes out those it holds; what it holds with more words between is held by these, too
    w = F.split("phrase", " ")
    held = candidates.where("words > 2").select("lang", "f", F.explode(F.array(_part(w, F.lit(1), F.col("words") - 1), _part(w, F.lit(2), F.col("words") - 1))).alias("phrase"))
    longest = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(longest, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * f").drop("longer")
    kept = tk.cut(kept.select("lang", "phrase", "words", F.col("f").alias("a"), _key(F.col("phrase")).alias("whole")), "collocation-candidates")

    cuts = kept.select("lang", "whole", "words", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "whole", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(F.col("w"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("s"))
    answers = _answered(sides.select("whole", "k", F.col("s.side").alias("side"), _key(F.col("s.part")).alias("key")), counts, "f")
    both = answers.groupBy("whole", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    sized = kept.join(tk.small(totals.select("lang", "n")), "lang").select("lang", "phrase", "whole", "a", "n")
    wide = lambda c: c.cast("decimal(18,0)")
    products = {"top": wide(1000 * F.col("a")) * wide(F.col("n")), "under": wide(F.col("l")) * wide(F.col("r"))}
    scored = sized.join(both, "whole").withColumns(products).withColumn("score", F.expr("top div under"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

    # the best of a language are the best of its salted shares' best
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(docs: list[tuple[str | None, str | None]], most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP) -> list[tuple]:
    """(lang, text) documents by plain counting, for tests."""
    import re
    from collections import Counter as Tally

    out = []
    docs = [(NO_LANG if x is None else x, t) for x, t in docs]
    for lang in {x for x, _ in docs}:
        f: Tally = Tally()
        for _, text in (d for d in docs if d[0] == lang):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(w[i : i + k]) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) >= 2 and c >= least}
        rows = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * c >= 100 * a and inside(q) for q, c in found.items()):
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows[:top])]
    return sorted(out)


ORACLE = rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
d as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w, count(*) as m from p group by lang, piece),
n as (select lang, sum(m * len(w))::hugeint as n from d group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, m from (select lang, w, m, k, unnest(range(1, len(w) - k + 2)) as i from d, (select unnest(range(1, {MOST_WORDS + 1})) as k) where len(w) >= k)),
f as materialized (select lang, k, phrase, sum(m)::hugeint as f from g group by all having sum(m) >= {LEAST}),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2),
s as (select lang, array_to_string(w[i:i + j - 1], ' ') as phrase, max(a) as longer from (select lang, w, k, a, j, unnest(range(1, k - j + 2)) as i from (select *, unnest(range(2, k)) as j from c)) group by all),
kept as (select c.* from c left join s using (lang, phrase) where longer is null or 100 * longer < 100 * a),
cut as (select lang, phrase, a, k, j, array_to_string(w[1:j], ' ') as x, array_to_string(w[j + 1:k], ' ') as y from (select *, unnest(range(1, k)) as j from kept)),
v as (select cut.lang, cut.phrase, a, l.f as l, r.f as r, n, j, (1000 * a * n) // (l.f * r.f) as score from cut join f l on cut.lang = l.lang and cut.x = l.phrase join f r on cut.lang = r.lang and cut.y = r.phrase join n on cut.lang = n.lang),
b as (select * from v qualify row_number() over (partition by lang, phrase order by score, j) = 1),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from t where rank <= {TOP}
"""
