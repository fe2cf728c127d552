"""Benchmark decontamination (4), with DataFrame and SQL functions only.

The benchmark's windows of n consecutive words become a broadcast hash set.
Each document is scanned once: its window hashes are made inside one array,
exploded and probed in the same code-generated stage (the words travel by
reference and are copied for hits only), each hit is verified word by word, and
a row stands for every document besides, so documents without hits need no
second scan and no join.  The only shuffle carries one small row per document
and task.

The set is broadcast while its counted rows are at most ``BROADCAST_ROWS``;
beyond that the same join is left to Spark, which shuffles both sides.

Defined results: null and empty texts have no words, no hits; items without
words have no window; an item of fewer than n words is one window; repeated
documents are reported row by row; repeated items (same id) count once; empty
tables give no hits or no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

N_WORDS = 10
BROADCAST_ROWS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(h, k, gram, items): each distinct window, its length and the items that have it."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    k = F.least(F.lit(n), F.size("w"))
    grams = words.select("item", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))).alias("gram"))
    return grams.groupBy("k", "gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("h"), "k", "gram", "items")


def _window(k: int):
    return lambda i: F.xxhash64(F.slice("w", i, F.lit(k)))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: (row_id, id, text_hash, n_words, places: sorted (pos, k) of windows that occur, items)."""
    grams = benchmark_windows(benchmark, n, item_col, item_text_col)
    sizes = {r.k: r.c for r in grams.groupBy("k").agg(F.count("*").alias("c")).collect()}  # at most n rows
    if sum(sizes.values()) <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    words = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    n_words = F.size("w")
    # posexplode_outer: no array is empty, and Spark adds no filter that would make the hashes twice
    # element 0 stands for the document; then the windows of each length that the benchmark has, one after the other
    parts, offset, start = [F.array(F.lit(0).cast("long"))], F.lit(1), {}
    for k in sorted(sizes, reverse=True):
        start[k] = offset
        parts.append(F.when(n_words >= k, F.transform(F.sequence(F.lit(1), F.greatest(n_words - k + 1, F.lit(1))), _window(k))).otherwise(F.array().cast("array<bigint>")))
        offset = offset + F.greatest(n_words - k + 1, F.lit(0))
    flat = words.select("row_id", "id", "text_hash", "w", F.concat(*parts).alias("hashes")).select("row_id", "id", "text_hash", "w", F.posexplode_outer("hashes").alias("at", "h"))
    met = flat.join(grams, (flat.at > 0) & (flat.h == grams.h), "left")
    place = F.col("at") - F.coalesce(*[F.when(F.col("k") == k, s) for k, s in start.items()], F.lit(0)) if start else F.lit(0)
    real = F.when((F.col("at") > 0) & F.col("k").isNotNull() & (place >= 0), F.slice("w", F.greatest(place, F.lit(0)) + 1, F.col("k")) == F.col("gram"))
    kept = met.where((F.col("at") == 0) | real).select("row_id", "id", "text_hash", n_words.cast("long").alias("n_words"), F.when(F.col("at") > 0, F.struct(place.alias("pos"), F.col("k").alias("k"))).alias("place"), F.col("items"))
    by_row = kept.groupBy("row_id", "id", "text_hash", "n_words").agg(F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return by_row


def _covered() -> Column:
    """Words inside the union of the places."""
    return F.expr("aggregate(places, named_struct('e', 0, 'n', 0L), (a, x) -> named_struct('e', greatest(a.e, x.pos + x.k), 'n', a.n + greatest(0, x.pos + x.k - greatest(a.e, x.pos))), a -> a.n)")


def report(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, **columns: str) -> DataFrame:
    return hits(docs, benchmark, n, **columns).select("id", "text_hash", "n_words", _covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The documents without any hit, columns unchanged."""
    bad = tk.small(tk.cut(report(docs, benchmark, n, id_col=id_col, text_col=text_col, **columns).where("contaminated").select(F.col("id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct(), "contaminated"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs[text_col]) == bad["__bad_hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """All documents; from those with hits the words inside the windows are taken out of the text, each with what separates it from the next word."""
    found = hits(docs, benchmark, n, id_col=id_col, text_col=text_col, **columns).where(F.size("places") > 0).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("places").alias("__places")).dropDuplicates(["__id", "__hash"])
    joined = docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col]) == found["__hash"]), "left")
    lead = F.regexp_extract(F.col(text_col), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    left = F.filter(pieces, lambda x, i: ~F.exists("__places", lambda p: (i >= p.pos) & (i < p.pos + p.k)))
    text = F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(docs, benchmark).select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (select distinct item, k, w[i:i + k - 1] as gram from (select item, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select r, k, i, w[i:i + k - 1] as gram from (select r, k, w, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from g) where len(w) >= k)),
h as (select r, item, i, k from dw join g using (k, gram)),
p as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from h) group by r),
s as (select r, count(distinct item) as n, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(p.n, 0)::bigint as n_hit, coalesce(s.n, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, p.n is not null as contaminated
from d left join p using (r) left join s using (r)
"""
