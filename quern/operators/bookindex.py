"""The stored search index: nodes with their vectors and contexts, and postings, by book; searched as they are stored.

A query embeds and tokenises itself alone.  BM25 takes the postings of its
terms, which lie in the order of terms within each bucket's files, and the
terms' document frequencies, which are sums of the changes that batches made.
A batch builds, embeds and tokenises its own books, and writes only these (see
``segments``).  The scores equal those of an index built at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import store, tree
from quern.operators.bm25 import EPSILON, NOTHING, PRODUCT, Kept, Weights, blocks, gain, gains, in_places, raw_idf
from quern.operators.rank import INDEXED, PLACES, HybridIndex, hybrid, index_text, top_k
from quern.operators.segments import BUCKETS, MOST_SEGMENTS, Segments, bucket
from quern.plans.tables import drop, few, folders, kept, scratch, written

TABLES = {
    "pages": "book_id string, page_num int, title string, text string, image_ids array<string>, ocr_texts array<string>",
    "nodes": f"{tree.NODES}, path string, context string, vector array<float>",
    "postings": "term string, node_id string, book_id string, tf int, dl int",
    "terms": "term string, change bigint",
}
SUMS = ("nodes", "indexable", "length")
SEEDS = 4  # postings for each of the k best that give a query's first bound
AT_ONCE = 1 << 16  # postings that a task scores together
PUSHED_TERMS = 1000  # up to so many query terms reach the scan of the postings


class BookIndex(HybridIndex):
    """The index stored below ``root``; size, overlap and the segments are those of ``tree.build``.  ``indexed`` and ``scored`` read the version that was current when it was opened or last changed."""

    def __init__(self, spark: SparkSession, root: str, embed=V.hash_embedding, buckets: int = BUCKETS, size: int = 1200, overlap: int = 180, segment=None, segment_rows=None):
        self.spark, self.root, self.embed = spark, root, embed
        self.cut = {"size": size, "overlap": overlap, "segment": segment, "segment_rows": segment_rows}
        self.tables = Segments(spark, root, TABLES, {"terms": "term"}, SUMS, buckets)
        self._sparse, self._mean = None, None

    @property
    def exists(self) -> bool:
        return self.tables.version is not None

    @property
    def nodes(self) -> DataFrame:
        return self.tables.read("nodes").select(*store.node_columns())

    @property
    def indexed(self) -> DataFrame:
        return self.tables.read("nodes").where(F.col("level").isin(INDEXED)).withColumn("index_text", index_text()).drop("bucket")

    def upsert(self, books: DataFrame, pages: DataFrame, images: DataFrame | None = None, about: dict | None = None) -> dict:
        """Brings books (book_id, title) in, with all their pages, in place of what the index has of them; the others stay as they are.

        Returns the numbers of books and nodes of this batch and of the index.  What the batch wrote on its way is
        deleted at the end, and the tree's tables as soon as its nodes are written.
        """
        with scratch(self.spark):
            return self._upsert(books, pages, images, about)

    def _upsert(self, books: DataFrame, pages: DataFrame, images: DataFrame | None, about: dict | None) -> dict:
        books = written(books.select("book_id", "title"), "batch-books")
        pages = written(pages.join(books.withColumnRenamed("title", "book_title"), "book_id").withColumn("title", F.col("book_title")).select(*self._columns("pages")), "batch-pages")
        with scratch(self.spark):
            made = kept(written(tree.build(pages.drop("title"), books, images, **self.cut), "batch-nodes"))
        wanted = F.col("level").isin(INDEXED)
        with scratch(self.spark):
            nodes = kept(written(tree.with_context(made), "batch-contexts"))
        drop(self.spark, folders(made))
        postings = written(self._postings(nodes), "batch-postings")
        n_nodes = nodes.groupBy("book_id").agg(F.count("*").alias("nodes"), F.count_if(wanted).alias("indexable"))
        length = postings.groupBy("book_id").agg(F.sum("tf").alias("length"))
        named = written(books.select("book_id").distinct().join(n_nodes, "book_id", "left").join(length, "book_id", "left").fillna(0, [*SUMS]), "batch-sums")
        added = lambda: self._frequencies(postings, 1).unionByName(self._frequencies(self.tables.before("postings", books), -1))
        # vectors are made as the dealt nodes are written: they are stored once and never shuffled
        vector = {"nodes": {"vector": F.when(wanted, self.embed(F.when(wanted, index_text())))}}
        version = self._change(named, {"pages": pages, "nodes": nodes, "postings": postings, "terms": lambda: self._change_of_terms(added())}, about=about, late=vector, spent=(pages, nodes))
        batch = named.agg(F.count("*").alias("books"), F.sum("nodes").alias("nodes")).first()
        return {"version": version, "books": batch.books, "book_nodes": batch.nodes or 0, "total_nodes": self.tables.totals["nodes"], "indexable_nodes": self.tables.totals["indexable"]}

    def remove(self, books: DataFrame) -> str:
        """Takes books (book_id) out."""
        gone = written(books.select("book_id").distinct(), "batch-books")
        none = {t: self.spark.createDataFrame([], TABLES[t]) for t in ("pages", "nodes", "postings")}
        nobody = gone.limit(0).select("book_id", *[F.lit(0).cast("long").alias(c) for c in SUMS])
        return self._change(nobody, none | {"terms": lambda: self._change_of_terms(self._frequencies(self.tables.before("postings", gone), -1))}, gone)

    def compact(self, most: int = MOST_SEGMENTS) -> set[int]:
        done = self.tables.compact(most)
        self._sparse = None
        return done

    def _change(self, named: DataFrame, make: dict, gone: DataFrame | None = None, about: dict | None = None, late: dict | None = None, spent: tuple[DataFrame, ...] = ()) -> str:
        version = self.tables.replace(named, make, gone, about, late, spent)
        self._sparse, self._mean = None, None
        if self.tables.crowded():
            self.compact()
            version = self.tables.version
        return version

    def _columns(self, table: str) -> list[str]:
        return [c.strip().split(" ")[0] for c in TABLES[table].split(", ")]

    def _postings(self, nodes: DataFrame) -> DataFrame:
        # nodes are dealt before their tokens are rows: an aggregation of tokens then shuffles nothing, and a node's postings stay together
        words = nodes.where(F.col("level").isin(INDEXED)).select("node_id", "book_id", T.tokens(index_text()).alias("tokens")).repartition("node_id")
        each = words.select("node_id", "book_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        return each.groupBy("term", "node_id", "book_id", "dl").agg(F.count("*").cast("int").alias("tf"))

    def _frequencies(self, postings: DataFrame, sign: int) -> DataFrame:
        """(bucket, term, change): the documents of each term."""
        placed = postings.select("term", bucket(F.col("book_id"), self.tables.buckets).alias("bucket"))
        return placed.groupBy("bucket", "term").agg((sign * F.count("*")).alias("change"))

    def _change_of_terms(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy("bucket", "term").agg(F.sum("change").alias("change")).where("change <> 0")

    def _mean_idf(self) -> float:
        """The mean of all terms' raw weights: one aggregation for each version, then kept beside it."""
        if self._mean is None:
            path = f"{self.root}/{self.tables.version}/idf.json"
            kept = store.read_text(self.spark, path)
            if kept is None:
                n = self.tables.totals["indexable"]
                mean = self.tables.read("terms").agg(F.avg(raw_idf(float(n), F.col("change")))).first()[0] or 0.0
                store.write_text(self.spark, path, kept := json.dumps({"mean": mean}))
            self._mean = json.loads(kept)["mean"]
        return self._mean

    def best(self, queries: DataFrame, levels: list[str], k: int, parents: DataFrame | None = None) -> DataFrame:
        """As in HybridIndex, from the stored postings and vectors: pairs are joined, so that a query tokenises nothing but itself."""
        every = self.indexed.where(F.col("level").isin(levels)).select("node_id", "parent_id")
        if parents is None:
            pairs = every.select("node_id").join(F.broadcast(queries.select("query_id")))
        else:
            near = written(every.join(parents.select("query_id", F.col("node_id").alias("parent_id")), "parent_id").select("query_id", "node_id"), "near")
            alone = queries.select("query_id").join(near.select("query_id").distinct(), "query_id", "left_anti")
            pairs = near.unionByName(every.select("node_id").join(F.broadcast(alone)).select("query_id", "node_id"))
        return top_k(hybrid(self.scored(queries, pairs)), k, tie=("ord", "node_id")).select("query_id", "node_id", "rank", "score", "dense", "sparse", "rune_boost")

    def full(self, found: DataFrame) -> DataFrame:
        found = written(found, "found")
        return found.join(self.tables.read("nodes").drop("bucket", "vector", "context").join(few(found.select("node_id").distinct()), "node_id", "left_semi"), "node_id")

    def sparse(self, queries: DataFrame) -> DataFrame:
        """BM25 of the queries from the stored postings, made once and kept for the stages that follow."""
        if self._sparse is None or self._sparse[0] is not queries:
            self._sparse = (queries, written(self._scores(queries), "sparse"))
        return self._sparse[1]

    def _wanted(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """(query_id, term, weight, df) of the queries' terms, the postings of these terms, and the mean length."""
        n, length = self.tables.totals["indexable"], self.tables.totals["length"]
        asked = written(queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
        terms = asked.select("term").distinct()
        pushed = [r.term for r in terms.limit(PUSHED_TERMS + 1).collect()]
        narrow = (lambda rows: rows.where(F.col("term").isin(pushed))) if len(pushed) <= PUSHED_TERMS else (lambda rows: rows.join(few(terms), "term", "left_semi"))
        df = narrow(self.tables.raw("terms")).groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")
        raw = raw_idf(float(n), F.col("df"))
        idf = df.select("term", "df", F.when(raw < 0, F.lit(EPSILON * self._mean_idf())).otherwise(raw).alias("idf"))
        wanted = written(asked.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "df"), "wanted")
        return wanted, narrow(self.tables.read("postings")), length / n if n else 0.0

    def _scores(self, queries: DataFrame) -> DataFrame:
        wanted, found, mean = self._wanted(queries)
        scored = found.select("node_id", "term", _gain("tf", "dl", mean).alias("gain"))
        return scored.join(few(wanted.drop("df")), "term").groupBy("query_id", "node_id").agg(F.sum(F.col("gain") * F.col("weight")).alias("sparse_raw"))

    def sparse_top_k(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, node_id, score, rank): the k best nodes by BM25 alone; ties by node_id.

        Queries go out in blocks.  The postings of a block's terms are dealt by
        node; a task scores its nodes for all queries of the block, some at a
        time, and keeps k rows for each query.  So no pair of a query and a node
        is written or shuffled, and rows are those of all scores, ranked.
        """
        wanted, found, mean = self._wanted(queries)
        rows = found.select("node_id", "term", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl"))
        n = blocks(wanted.select("query_id").distinct().count(), wanted.count())
        out = None
        for b in range(n):
            block = wanted if n == 1 else written(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b), "block")
            dealt = rows if n == 1 else rows.join(few(block.select("term").distinct()), "term", "left_semi").select(*rows.columns)
            best = written(_best(dealt, Weights.of(block), mean, k, queries.schema["query_id"].dataType.simpleString()), "best")
            out = best if out is None else out.unionByName(best)
        w = Window.partitionBy("query_id").orderBy(F.desc("key"), "node_id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")

    def _candidates(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Complete scores of the nodes that can be among the k best, as pairs, and each query's bound.

        A query's rare terms give a first score that its k-th best node reaches
        at least.  In each bucket the terms whose highest possible gains do not
        add up to it are left aside: nodes that have only these are never paired
        with the query, and of the others only those are completed that can still
        reach it.  Queries with a negative weight (only in corpora where most
        terms are in most nodes) are not pruned.
        """
        wanted, found, mean = self._wanted(queries)
        postings = written(found.select("term", "node_id", "bucket", "tf", "dl"), "asked-postings")
        gains = postings.select("term", "node_id", "bucket", _gain("tf", "dl", mean).alias("gain"))
        scored = lambda terms, by: gains.join(terms, by).groupBy("query_id", "node_id", "bucket").agg(F.sum(F.col("gain") * F.col("weight")).alias("score"))

        # the terms with the fewest postings until there are enough of them
        rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        seeds = wanted.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < SEEDS * k)
        best = top_k(scored(few(seeds.select("query_id", "term", "weight")), "term"), k, tie="node_id")
        bound = best.where(F.col("rank") == k).select("query_id", (F.col("score") - 2.0 * 10**-PLACES).alias("bound"))
        negative = wanted.groupBy("query_id").agg(F.min("weight").alias("least")).where("least < 0").select("query_id")
        bound = written(bound.join(negative, "query_id", "left_anti"), "bounds")

        # in each bucket: the most that each term can add, and whether it and all smaller ones stay below the bound
        peaks = postings.groupBy("term", "bucket").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        most = peaks.join(few(wanted), "term").select("query_id", "bucket", "term", "weight", (F.col("weight") * _gain("tf", "dl", mean)).alias("most"))
        up = Window.partitionBy("query_id", "bucket").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        most = most.withColumn("upto", F.sum("most").over(up)).join(few(bound), "query_id", "left")
        most = written(most.withColumn("aside", F.coalesce(F.col("upto") < F.col("bound"), F.lit(False))), "terms")
        aside = most.where("aside")
        rest = aside.groupBy("query_id", "bucket").agg(F.sum("most").alias("rest"))
        first = scored(few(most.where("not aside").select("query_id", "bucket", "term", "weight")), ["term", "bucket"])
        first = first.join(few(rest), ["query_id", "bucket"], "left").join(few(bound), "query_id", "left")
        first = written(first.where(F.col("bound").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("bound"))).select("query_id", "node_id", "bucket", "score"), "candidates")
        asides = gains.join(few(aside.select("query_id", "bucket", "term", "weight")), ["term", "bucket"]).join(few(first.select("query_id", "node_id")), ["query_id", "node_id"], "left_semi")
        more = asides.select("query_id", "node_id", (F.col("gain") * F.col("weight")).alias("score"))
        return first.select("query_id", "node_id", "score").unionByName(more).groupBy("query_id", "node_id").agg(F.sum("score").alias("score")), bound


def _gain(tf: str, dl: str, mean: float):
    return gain(F.col(tf).cast("double"), F.col(dl).cast("double"), mean)


def _best(postings: DataFrame, weights: Weights, mean: float, k: int, kind: str) -> DataFrame:
    """(query_id, node_id, score, key) of each task's k best nodes for each query; postings: (node_id, term, tf, dl)."""
    shared = postings.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        kept = Kept(len(weights.names), k)
        at_once = max(1, PRODUCT // max(1, len(weights.names)))

        def add(rows: pa.Table, last: bool) -> pa.Table:
            """Scores the nodes whose rows are all there; gives back the others."""
            node = rows.column(0).combine_chunks()
            new = np.concatenate([[True], pc.not_equal(node.slice(1), node.slice(0, len(node) - 1)).to_numpy(zero_copy_only=False)])
            begin = np.flatnonzero(new)
            begin, end = (begin, len(node)) if last else (begin[:-1], begin[-1])
            of = np.cumsum(new[:end]) - 1
            term = pc.index_in(rows.column(1).combine_chunks().slice(0, end), weights.terms).to_numpy(zero_copy_only=False).astype(np.int64)
            got = gains(*(rows.column(i).to_numpy()[:end] for i in (2, 3)), mean)
            for lo in range(0, len(begin), at_once):
                n = min(at_once, len(begin) - lo)
                i, j = np.searchsorted(of, [lo, lo + n])
                score, hit = weights.summed(n, of[i:j] - lo, term[i:j], got[i:j])
                names = node.take(pa.array(begin[lo : lo + n])).to_numpy(zero_copy_only=False)
                kept.add(np.where(hit, in_places(score), NOTHING), [names], [score])
            return rows.slice(end)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                rest = add(pa.Table.from_batches(held), False)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            add(pa.Table.from_batches(held), True)
        if len(kept):
            yield pa.RecordBatch.from_arrays([weights.names.take(pa.array(kept.q)), pa.array(kept.ties[0], pa.string()), pa.array(kept.values[0]), pa.array(kept.key)], ["query_id", "node_id", "score", "key"])

    return postings.repartition("node_id").sortWithinPartitions("node_id").mapInArrow(run, f"query_id {kind}, node_id string, score double, key bigint")
