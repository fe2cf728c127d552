"""The queries over the driver's tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import chunks as C
from quern.functions import geometry as G
from quern.functions import responses as R
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import datasets, imaging, rank, store, tree
from quern.operators.bm25 import Bm25
from quern.operators.bookindex import BookIndex
from quern.plans.tables import folder, spread, written
from quern.sources.pages import document_pages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found  # its texts are the work


# DuckDB forms of the text functions
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOK = r"[\p{L}\p{N}_-]+"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOK}'))"


def n_of(x: str, keep: str) -> str:
    return f"length(regexp_replace({x}, '[^{keep}]', '', 'g'))"


TEXT = "coalesce(text, '')"
LINES = rf"""lines as (
  select doc_id, i, {ws("x")} as s from (
    select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from (
      select doc_id, string_split_regex({TEXT}, '\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{{2028}}\x{{2029}}]') as l from documents)))"""


@query(f"""select doc_id, {n_tokens(TEXT)}::bigint as n_tokens,
  len(list_filter(string_split(regexp_replace({ws(TEXT)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::bigint as n_sentences from documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(text)).cast("long").alias("n_tokens"), F.size(T.sentences(text)).cast("long").alias("n_sentences"))


_M = f"(select doc_id, {TEXT} as t, {ws(TEXT)} as s from documents)"


@query(f"""select doc_id, n::bigint as token_count, a::bigint as alpha_char_count, c::bigint as char_count, k as keep, round(case when k then least(1.0, least(1.0, n / 28.0::double) * 0.5::double + least(1.0, a / 120.0::double) * 0.4::double + case when m then 0.1::double else 0 end) else 0 end, 9) as quality,
  round(case when length(solid) > 0 then {n_of("solid", "\\x{16A0}-\\x{16FF}\\x{10C00}-\\x{10C4F}")} / length(solid)::double else 0 end, 9) as rune_density
from (select *, (n >= 4 or a >= 18 or c >= 42 or m) and c >= 2 as k from (
  select doc_id, {n_tokens("s")} as n, {n_of("s", "\\p{L}")} as a, length(s) as c, contains(t, '[OCR]') or contains(t, '[IMAGE ') as m, regexp_replace(t, '{WS}+', '', 'g') as solid from {_M}))""")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", C.metrics(text).alias("m"), T.rune_density(text).alias("d"))
    return rows.select("doc_id", F.col("m.token_count").cast("long").alias("token_count"), F.col("m.alpha_char_count").cast("long").alias("alpha_char_count"), F.col("m.char_count").cast("long").alias("char_count"), F.col("m.keep").alias("keep"), F.round("m.quality", 9).alias("quality"), F.round("d", 9).alias("rune_density"))


_RUNES = [("ᚠᚢ abc", 0.4), ("𐰀 𐰁", 1.0), ("plain", 0.0), ("", 0.0), ("   ", 0.0), ("a ᚠ", 0.5)]
_ASKED = [("What is a rune?", True), ("RUNES of the north", True), ("prunes", False), ("руна", True), ("рунический", False), ("орхонский", False), ("runic", True), ("", False)]


@query("select * from (values " + ", ".join(f"('{a}', {b}::double)" for a, b in _RUNES) + ") t(s, density)")
def rune_density_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _RUNES], "s string").select("s", T.rune_density(F.col("s")).alias("density"))


@query("select * from (values " + ", ".join(f"('{a}', {str(b).lower()})" for a, b in _ASKED) + ") t(s, is_rune_query)")
def rune_query_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _ASKED], "s string").select("s", T.is_rune_query(F.col("s")).alias("is_rune_query"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("i", "x")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), T.collapse(F.col("x")).alias("s"))


@query(f"""with {LINES} select doc_id, i::bigint as i, s from lines
where s = '' or (regexp_matches(s, '(?:^| )[-–—]? ?\\d+ ?/ ?\\d+$') and {n_tokens("s")} >= 4) or regexp_matches(s, '^\\d+ ?/ ?\\d+$')""")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(T.is_page_noise(F.col("s")))


_LET, _UP = n_of("s", "\\p{L}"), n_of("s", "\\p{Lu}")


@query(f"""with {LINES}, w as (select *, case when s = '' then [] else string_split(s, ' ') end as ws, regexp_extract(s, '^(\\d+(?:\\.\\d+){{0,3}})[.)] (.+)$', 1) as np, regexp_extract(s, '^(\\d+(?:\\.\\d+){{0,3}})[.)] (.+)$', 2) as nt,
  regexp_extract(s, '^([IVXLCM]{{1,8}})[.)] (.+)$', 1) as rp, trim(regexp_extract(s, '^([IVXLCM]{{1,8}})[.)] (.+)$', 2)) as rt from lines),
f as (select doc_id, i, case
  when length(s) < 3 or (len(ws) <= 2 and regexp_matches(s, '(?i)^[A-Z]?\\d[\\p{{L}}\\p{{N}}_./-]*$')) or regexp_matches(s, '^[0-9A-FXx]{{3,6}}; ') or regexp_matches(s, '\\.{{5,}}') or regexp_matches(s, '[,;:–—-]$') then null
  when np <> '' then case when length(nt) <= 90 and not regexp_matches(nt, '[.!?]$') and {n_of("nt", "\\p{L}")} >= 3
    then {{'level': case when len(string_split(np, '.')) = 1 and length(nt) > 48 then 2 else least(3, len(string_split(np, '.'))) end, 'title': trim(nt)}} end
  when rp <> '' and len(ws) <= 8 and length(s) <= 80 and (length(rp) > 1 or rp in ('I', 'V', 'X')) and {n_of("rt", "\\p{L}")} >= 3 then {{'level': 1, 'title': rt}}
  when len(ws) <= 10 and length(s) <= 84 and not regexp_matches(s, '[.!?]$') and {_LET} >= 3 and ({_UP} > 0.72 * {_LET}
    or (len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}') and regexp_matches(x, '\\p{{L}}'))) > 0.8 * len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) and len(ws) <= 7 and length(s) <= 68)) then {{'level': 2, 'title': s}} end as h from w)
select doc_id, i::bigint as i, h.level::int as level, h.title as title from f where h is not null""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("h", T.heading(F.col("s"))).where(F.col("h").isNotNull()).select("doc_id", "i", F.col("h.level").alias("level"), F.col("h.title").alias("title"))


@query(f"select doc_id, case when length({ws(TEXT)}) <= 120 then {ws(TEXT)} else substr({ws(TEXT)}, 1, 117) || '...' end as snippet from documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.coalesce("text", F.lit("")), 120).alias("snippet"))


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.split_text(F.coalesce("text", F.lit("")), 1200, 180)).alias("k", "chunk"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.semantic_chunks(F.coalesce("text", F.lit("")))).alias("k", "chunk"))


@query()
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", C.covers(text, C.source_windows(text, 8000), 0).alias("covered"))


# -- BM25 and dense search ---------------------------------------------------------------------------------

_STATS = f"""d as (select doc_id, list_transform(regexp_extract_all({TEXT}, '{TOK}'), lambda x: lower(x)) as t from documents),
e as (select doc_id, unnest(t) as term from d),
tf as (select doc_id, term, count(*)::double as tf from e group by all),
df as (select term, count(*) as df from tf group by term),
n as (select count(*)::double as n, avg(len(t)::double) as mean from d),
raw as (select term, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) as raw from df, n),
mean_raw as (select avg(raw) as mean_raw from raw),
idf as (select term, df, case when raw < 0 then 0.25::double * mean_raw else raw end as idf from raw, mean_raw)"""


@query(f"with {_STATS} select term, df::bigint as df, round(idf, 6) as idf from idf")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Bm25(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text").idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""with {_STATS},
q as (select item_id, unnest(list_transform(regexp_extract_all({TEXT}, '{TOK}'), lambda x: lower(x))) as term from benchmark),
qt as (select item_id, term, count(*) as times from q group by all),
s as (select item_id as query_id, doc_id, sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len(t)::double / mean))) as s from qt join tf using (term) join idf using (term) join d using (doc_id), n group by all),
r as (select *, row_number() over (partition by query_id order by round(s, 6) desc, doc_id) as rank from s)
select query_id, doc_id, round(s, 6) as score, rank::int as rank from r where rank <= 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return Bm25(docs, "doc_id", "text").top_k(asked, 10).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("""with s as (select q.vec_id as query_id, e.vec_id as vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)) as s from embeddings q, embeddings e where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by round(s, 6) desc, vec_id) as rank from s)
select query_id, vec_id, round(s, 6) as score, rank::int as rank from r where rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all: queries go out in broadcast blocks of bounded size."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    found = rank.dense_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asked, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query()
def hash_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", V.hash_embedding(F.col("text")).alias("v"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), V.hash_embedding(F.col("text")).alias("asked"))
    return rank.dense_top_k(docs.withColumnRenamed("doc_id", "id"), asked, 5).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("select event_id, event_type, round(case when max(value) over w - min(value) over w < 1e-9 then 0 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled from events window w as (partition by event_type)")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = rank.minmax(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", {"scaled": "value"})
    return scaled.select("event_id", "event_type", F.round("scaled", 6).alias("scaled"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates made of events, so that the blend has an SQL form."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.pmod("user_id", F.lit(50)).alias("query_id"), F.concat(F.lit("runes of user "), F.pmod("user_id", F.lit(50)).cast("string")).alias("query"), F.col("event_id").alias("ord"), F.lit("chunk").alias("level"), F.col("event_type").alias("context"), F.col("event_type").alias("text"),
        F.coalesce("value", F.lit(0.0)).alias("dense_raw"), (F.pmod("event_id", F.lit(97)) * 1.0).alias("sparse_raw"), (F.pmod("event_id", F.lit(10)) / 10.0).alias("chunk_quality"), F.lit(None).cast("double").alias("image_quality"), (F.pmod("event_id", F.lit(4)) / 8.0).alias("rune_density"), F.array().cast("array<string>").alias("image_ids"),
    )


@query("""with c as (select user_id % 50 as query_id, event_id as ord, coalesce(value, 0.0) as d, (event_id % 97)::double as s, (event_id % 10) / 10.0::double as q, 0.12::double * least(1.0, (event_id % 4) / 8.0::double) as b from events),
m as (select *, case when max(d) over w - min(d) over w < 1e-9 then 0 else (d - min(d) over w) / (max(d) over w - min(d) over w) end as dn, case when max(s) over w - min(s) over w < 1e-9 then 0 else (s - min(s) over w) / (max(s) over w - min(s) over w) end as sn from c window w as (partition by query_id)),
r as (select query_id, ord, (0.65::double * dn + 0.35::double * sn + b) * case when q < 0.5 then (0.35::double + 0.65::double * q) * q else 0.35::double + 0.65::double * q end as score from m)
select query_id, ord, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 6) desc, ord) as rank from r) where rank <= 8""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(rank.hybrid(_candidates(spark, sf_dir)), 8).select("query_id", "ord", F.round("score", 6).alias("score"), "rank")


# -- trees -------------------------------------------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers as a tree of nodes."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return (
        r.select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("book").alias("level"), F.col("r_name").alias("title"))
        .unionByName(n.select(key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id"), F.lit("chapter").alias("level"), F.col("n_name").alias("title")))
        .unionByName(c.select(key("c", "c_custkey").alias("node_id"), key("n", "c_nationkey").alias("parent_id"), F.lit("section").alias("level"), F.col("c_name").alias("title")))
        .withColumn("text", F.lit(""))
    )


@query("""select 'r' || r_regionkey as node_id, r_name as path from region union all select 'n' || n_nationkey, concat_ws(' > ', r_name, n_name) from nation left join region on n_regionkey = r_regionkey
union all select 'c' || c_custkey, concat_ws(' > ', r_name, n_name, c_name) from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_context(_places(spark, sf_dir)).select("node_id", "path")


@query("""with recursive e as (select 'r' || n_regionkey as p, 'n' || n_nationkey as c from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
t as (select p as ancestor_id, c as node_id, 1 as distance from e union all select t.ancestor_id, e.c, t.distance + 1 from t join e on t.node_id = e.p) select ancestor_id, node_id, distance::int as distance from t""")
def node_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendants(_places(spark, sf_dir)).select("ancestor_id", "node_id", "distance")


@query("""with recursive o as (select o_orderkey as k, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as p from orders),
t as (select k, p as a, 1 as d from o where p is not null union all select t.k, o.p, d + 1 from t join o on t.a = o.k where o.p is not null)
select a::varchar as ancestor_id, k::varchar as node_id, d::int as distance from t""")
def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep tree: each order hangs below its customer's order before it; all orders above all orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("p"))
    text = lambda c: F.col(c).cast("string")
    nodes = o.select(text("o_orderkey").alias("node_id"), text("p").alias("parent_id"), F.lit("order").alias("level"), text("o_orderkey").alias("title"))
    return tree.descendants(nodes).select("ancestor_id", "node_id", "distance")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.build(*reversed(document_pages(table(spark, sf_dir, "documents"))))


@query()
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("node_id", "parent_id", "level", "ord", "title", "page_from", "page_to", "token_count", F.round("chunk_quality", 6).alias("chunk_quality"))


@query()
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ingest_stats(_tree(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rank.retrieve(rank.HybridIndex(written(_tree(spark, sf_dir), "nodes")), asked)


@query()
def tree_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "place", "node_id", "level", F.round("score", 6).alias("score"), "path")


@query()
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten nodes for each benchmark text, from an index that is stored in two batches (one source of documents comes later) and whose postings and vectors are read back."""
    d = table(spark, sf_dir, "documents")
    index = BookIndex(spark, folder(spark, "stored"), buckets=16)
    for batch in (d.where("source is distinct from 'src0'"), d.where("source = 'src0'")):
        index.upsert(*document_pages(batch))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return index.sparse_top_k(asked, 10).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query()
def tree_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rank.answers(written(_hits(spark, sf_dir), "hits"), asked).select("query_id", "answer", F.size("reading_pages").alias("n_pages"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), (F.length(F.coalesce("text", F.lit(""))) / 1000.0).alias("score"), F.floor(F.col("turn") / 2).cast("int").alias("page_from"), F.floor(F.col("turn") / 2).cast("int").alias("page_to"), F.col("role").alias("level"), F.col("role").alias("path"), "text")


@query("""with t as (select conv_id as query_id, turn, floor(turn / 2)::int as p, role from conversations),
a as (select *, row_number() over (partition by query_id, p, role order by turn) as k from t), b as (select *, row_number() over (partition by query_id order by turn) as n from a where k = 1)
select query_id, n::int as n, p as page_from, p as page_to, role as level, role as path from b where n <= 12""")
def reading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.reading_pages(_turns(spark, sf_dir))


@query("""with t as (select conv_id as query_id, turn, length(coalesce(text, '')) / 1000.0::double as s, ((turn * 7919) % 13)::double as m from conversations),
b as (select *, 0.62::double * s + 0.38::double * case when max(m) over w - min(m) over w < 1e-8 then 0 else (m - min(m) over w) / (max(m) over w - min(m) over w) end as x from t window w as (partition by query_id))
select query_id, turn, (row_number() over (partition by query_id order by round(x, 6) desc, turn) - 1)::int as place from b""")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _turns(spark, sf_dir).withColumn("turn", F.col("place"))
    return rank.rerank(given, F.pmod(F.col("turn") * 7919, F.lit(13)).cast("double")).select("query_id", "turn", F.col("place").cast("int").alias("place"))


@query(f"""with s as (select conv_id as query_id, turn, role, {ws(TEXT)} as s from conversations where turn < 8)
select query_id, string_agg('[CTX ' || (turn + 1) || '] level=' || role || ' pages=' || (turn // 2) || '-' || (turn // 2) || chr(10) || 'path: ' || role || chr(10) || 'text: ' || case when length(s) <= 100 then s else substr(s, 1, 97) || '...' end, chr(10) || chr(10) order by turn) as context from s group by query_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.context_blocks(_turns(spark, sf_dir), 8, 100)


# -- store, responses, images ------------------------------------------------------------------------------


@query("select doc_id, source, case when source <> 'src0' and lang <> 'en' then 'new' else 'old' end as v from documents")
def upsert_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as old books, by source and language; those of one source, and of one language, do not come anew and stay old, as do those without either."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    new = d.where((F.col("source") != "src0") & (F.col("lang") != "en"))
    return store.upsert(d.withColumn("v", F.lit("old")), new.withColumn("v", F.lit("new")), ["source", "lang"]).drop("lang")


@query("select doc_id, source, case when source <> 'src0' then 'new' else 'old' end as v from documents")
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as old books, all but one source of them anew: rows of the one source, and of none, stay old."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return store.upsert(d.withColumn("v", F.lit("old")), d.where(F.col("source") != "src0").withColumn("v", F.lit("new")), "source")


_ANSWERS = [
    ('["first part", "second part"]', ["first part", "second part"]), ('{"chunks": [{"text": "one of them"}, {"content": "two of them"}, "three"]}', ["one of them", "two of them", "three"]),
    ('Sure!\n```json\n{"segments": ["fenced text"]}\n```', ["fenced text"]), ('noise ["inside noise"] more', ["inside noise"]), ("1. numbered one\n2) numbered two\n- bulleted", ["numbered one", "numbered two", "bulleted"]), ("nothing here", []),
]


@query("select * from (values " + ", ".join(f"({i}::bigint, '{'|'.join(b)}', {len(b)}::int)" for i, (_, b) in enumerate(_ANSWERS)) + ") t(i, segments, n)")
def response_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_ANSWERS)], "i bigint, raw string").withColumn("s", R.segments(F.col("raw")))
    return given.select("i", F.array_join("s", "|").alias("segments"), F.size("s").alias("n"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = F.pmod("l_partkey", F.lit(150)).cast("int"), F.pmod("l_suppkey", F.lit(150)).cast("int")
    side = (F.col("l_quantity") + 10).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("k"), left.alias("left"), top.alias("top"), (left + side).alias("right"), (top + side).alias("bottom"))


_BOXES = "b as (select l_orderkey as image, l_linenumber as k, (l_partkey % 150)::int as x, (l_suppkey % 150)::int as y, (l_quantity + 10)::int as z from lineitem)"


@query(f"""with {_BOXES}, p as (select b.image, b.k as a, c.k as b, greatest(0, least(b.x + b.z, c.x + c.z) - greatest(b.x, c.x)) * greatest(0, least(b.y + b.z, c.y + c.z) - greatest(b.y, c.y)) as o, b.z * b.z + c.z * c.z as s,
  not (b.x + b.z + 4 <= c.x or c.x + c.z + 4 <= b.x or b.y + b.z + 4 <= c.y or c.y + c.z + 4 <= b.y) as near from b join b c on b.image = c.image and b.k < c.k)
select image, a, b, round(o / (s - o)::double, 6) as iou from p where near or o / (s - o)::double > 0""")
def box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conflicts(_boxes(spark, sf_dir), "image", "k", 4)


@query(f"with {_BOXES} select image, k, round((x + z / 2.0) / 256.0, 6)::double as cx, round((y + z / 2.0) / 256.0, 6)::double as cy, round(z / 256.0, 6)::double as w from b")
def yolo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = _boxes(spark, sf_dir).withColumn("y", G.yolo(F.struct("left", "top", "right", "bottom"), F.lit(256), F.lit(256)))
    return y.select("image", "k", F.round("y.x", 6).alias("cx"), F.round("y.y", 6).alias("cy"), F.round("y.w", 6).alias("w"))


@query("select class_id::int as class_id, 'rune' || class_id as class_name, variant::int as variant, (class_id * 10 + variant)::bigint as counter, (42 + class_id * 10 + variant)::bigint as seed from (select unnest(range(24)) as class_id), (select unnest(range(10)) as variant)")
def dataset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.plan_samples(spark, [f"rune{i}" for i in range(24)], 10, 42)


@query("select p_partkey as path_key, case when (row_number() over (order by p_name, p_partkey) - 1) % 10 = 0 then 'val' else 'train' end as split from part")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenth of a stated order is for validation: ranks within ranges and the ranges' sizes, so no task sees all rows."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path_key"), "p_name")
    ranged = written(p.repartitionByRange("p_name", "path_key").sortWithinPartitions("p_name", "path_key").select("path_key", F.spark_partition_id().alias("part"), "p_name"), "ranged")
    local = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("p_name", "path_key")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    return local.join(F.broadcast(before), "part").select("path_key", F.when((F.col("base") + F.col("r") - 1) % 10 == 0, "val").otherwise("train").alias("split"))


@query("select event_type, round(quantile_cont(value, 0.66), 6) as q66, round(quantile_cont(value, 0.78), 6) as q78 from events group by event_type")
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.quantiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("""with h as (select p_brand, (floor(p_retailprice)::int % 256) as bin, count(*)::double as n from part group by all),
c as (select p_brand, bin, sum(n) over r as w, sum(n * bin) over r as m, sum(n) over a as tw, sum(n * bin) over a as tm from h window r as (partition by p_brand order by bin), a as (partition by p_brand)),
s as (select p_brand, bin, case when tw - w > 0 then w * (tw - w) * power(m / w - (tm - m) / (tw - w), 2) else 0 end as s from c)
select p_brand, bin::int as threshold from (select *, row_number() over (partition by p_brand order by round(s, 6) desc, bin) as k from s) where k = 1""")
def otsu_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.pmod(F.floor("p_retailprice").cast("int"), F.lit(256)).alias("bin"))
    return imaging.otsu_table(p, "p_brand", "bin")
