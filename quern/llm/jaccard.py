"""N-gram Jaccard join (2): a blocked sparse matrix product of documents by n-grams.

Rows of the matrix are distinct n-gram sets (documents with one set are one
row), columns are n-grams.  The whole product is never made:

1.  One pass gives each document its set's size and 64-bit key, and counts
    n-grams in a sketch of fixed size.  The sketch only fixes an order of the
    columns, rare ones first; a poor order costs time, never a link.
2.  Sets of n that reach the threshold t share m n-grams among the first
    n - ceil(t n) + m of that order, whatever m; here m is 1 + n // 16 (of the
    smaller set).  Those entries are the sub-matrix that is shuffled by
    column.  Sets whose two least n-grams under two hashes agree, as near
    copies mostly do, are one row here, a bundle.  In columns of up to SHORT
    rows each pair of bundles of sizes within t adds to its overlap count, and
    pairs that stay below m are discarded: what bundles share is no less than
    what two of their sets share.  In longer columns rows are only chained, by
    size, so a pair that meets in one is never lost and never expanded.  A
    column so gives at most SHORT / 2 rows for each of its entries, whatever
    its length.  What remains joins bundles to families.  Chains may join
    what no link joins: where families so get too wide for their products,
    the n-grams of long columns go behind all others and the step is done
    again (a sketch of fixed size tells common ones apart less and less the
    more texts there are).
3.  Families are cut into blocks by size class and hash.  Only block pairs of
    the same or neighbouring size classes can hold links; each such pair is
    one product, accumulated over column chunks, whose entries below the bound
    100 o >= 75 (a + b - o) are dropped.  Texts come to the products in rounds,
    so that the shuffle stays in proportion to the families' texts, however
    often each is wanted.  What leaves a block pair is a forest with the
    links' components and each row's number of links, at most two rows per
    document.
4.  Components of the forests, distributed.

Exact copies are never expanded.  Defined results: null and empty texts (and
those without words) have no set and link with nothing; a text of fewer words
than n has its whole sequence as its one n-gram; repeated rows and repeated or
null ids are rows of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import graph
from quern.llm import textkernel as tk

N = 5
PERCENT = 75
SKETCH_BITS = 20
SKETCH_PART = 1 << 14  # counters in a row
FAN_IN = 64  # sketches added in one task
BUNDLE_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BLOCK_DOCS = 1024
BLOCK_GRAMS = 1_000_000
CLASS_BASE = 1.34  # above 100 / PERCENT, so that linked sizes are at most one class apart
COLUMNS = 4096
SHORT = 16
FILTER_BITS = 26  # at most 2**20 broadcast rows
SURE = 1 << 40  # the count of a chained pair
PLACED_BYTES = 16_000_000  # of members and their block pairs that are broadcast
WIDE = 2  # families are too wide where products want each of their n-grams more often than this
TRIES = 3  # orders of the columns
LATE = 2_000_000  # n-grams of long columns that an order knows
ROUND_GRAMS = 50_000_000  # a round of products takes so many n-grams at least


def shared_at_least(size):
    """Prefix entries that linked sets share, the smaller of this size (a number or a column)."""
    return 1 + (F.floor(size / 16) if isinstance(size, Column) else size // 16)


def _sets(data: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each document's distinct n-gram hashes, ascending."""
    starts, ends, first = tk.spans(tk.SPACE_WORD[data], off)
    h, bounds = tk.shingles(tk.span_hash(data, starts, ends, True), first, n)
    for d in range(len(off) - 1):
        yield np.unique(h[bounds[d] : bounds[d + 1]])


def _key(grams: np.ndarray) -> int:
    return int(tk.mix(np.array([tk.mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _bundle(grams: np.ndarray) -> int:
    """A number that near copies mostly share: a hash of the least n-grams under two orders."""
    least = np.array([tk.mix(grams ^ salt).min() for salt in BUNDLE_SALTS], np.uint64)
    return int(tk.mix(tk.mix(least[:1]) ^ least[1:]).view(np.int64)[0])


def profile(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (id, text_hash, n_grams, key, bundle) and, with part not null, of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["id", "text_hash", "n_grams", "key", "bundle", "part", "task", "counts"]
        for batch in batches:
            sizes, keys, bundles = [], [], []
            for _, _, data, off in tk.chunks(batch.column(2)):
                sets = list(_sets(data, off, n))
                sizes += [len(s) for s in sets]
                keys += [_key(s) if len(s) else None for s in sets]
                bundles += [_bundle(s) if len(s) else None for s in sets]
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bundles, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        parts = len(sketch) // SKETCH_PART
        none = pa.nulls(parts, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(parts), pa.int32()), pa.array([TaskContext.get().partitionId()] * parts, pa.int32()), pa.array([x.tobytes() for x in sketch.reshape(parts, -1)], pa.binary())], names)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "id bigint, text_hash bigint, n_grams bigint, key bigint, bundle bigint, part int, task int, counts binary")


def _added(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: a tree of additions; only the last, of fixed size, comes to the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_PART, np.uint32)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "task": pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    most = rows.agg(F.max("task")).first()[0]
    while most is not None:
        rows = rows.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("to")).applyInArrow(lambda t: add(t), "part int, task int, counts binary")
        most //= FAN_IN
        if not most:
            break
    for r in rows.toLocalIterator() if most is not None else ():
        out[r.part * SKETCH_PART : (r.part + 1) * SKETCH_PART] = np.frombuffer(r.counts, np.uint32)
    return out


def _links(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 * overlap >= percent * (a[:, None] + b[None, :] - overlap)) & (overlap > 0)


def product(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of all rows of one block with those of another (None: with itself), accumulated over chunks of columns."""
    every = left + (right or [])
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    gram, column = np.unique(np.concatenate(every), return_inverse=True)
    often = np.bincount(column, minlength=len(gram))
    number = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    column, row = number[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = int(column[-1]) + 1 if len(column) else 0
    n = len(left)
    out = np.zeros((n, len(right) if right is not None else n), np.float32)
    for lo in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(every), min(COLUMNS, width - lo)), np.float32)
        block[row[i:j], column[i:j] - lo] = 1
        out += block[:n] @ (block[n:] if right is not None else block).T
    return np.rint(out).astype(np.int64)


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_grams, component, n_links, text_hash): one row per document; component is the smallest id that links reach, n_links the number of rows that link with it directly."""
    return _classified(docs, n, percent, id_col, text_col).drop("root")


def _classified(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The join with root, the component's own number (null without a set): components whose smallest ids are equal or null stay apart."""
    spark = docs.sparkSession
    tk.modest_batches(docs)
    seen = tk.cut(profile(docs, n, id_col, text_col), "jaccard-sets")
    rows = seen.where("part is null").select("id", "text_hash", "n_grams", "key", "bundle")
    order = spark.sparkContext.broadcast(np.minimum(_added(seen.where("part is not null").select("part", "task", "counts")), 65535).astype(np.uint16))
    classes = rows.where("key is not null").groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.max("n_grams").alias("n_grams"), F.min("id").alias("least"), F.count("*").alias("copies"), F.max("bundle").alias("bundle"))
    classes = tk.cut(classes, "jaccard-sets-once")
    late, placed = np.zeros(0, np.uint64), None
    for left in reversed(range(TRIES)):
        met = tk.cut(_met(docs, n, percent, text_col, order, late), "jaccard-met")
        now = _placed(met, classes)
        if placed is not None and now[1] >= placed[1]:  # families are as wide as the texts make them
            break
        placed = now
        if not left or placed[1] <= WIDE * placed[2]:
            break
        late = np.union1d(late, _long_columns(met))
    links = _multiplied(docs, *placed, n, percent, id_col, text_col)
    roots = tk.cut(graph.components(links.where("v is not null").select("u", "v"), "jaccard-links"), "jaccard-roots")
    degrees = links.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    least = classes.select("key", "least", "copies")
    lowest = roots.join(least, roots.node == least.key).groupBy("root").agg(F.min("least").alias("component"))
    reached = roots.join(lowest, "root").select(F.col("node").alias("key"), "root", "component")
    n_links = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    by_key = tk.cut(least.join(reached, "key", "left").join(degrees, "key", "left").select("key", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("component", "least").alias("component"), n_links), "jaccard-classes")
    found = tk.spread_join(rows.where("key is not null"), by_key, "key", "copies").select("id", "n_grams", "component", "n_links", "text_hash", "root")
    without = rows.where("key is null").select("id", "n_grams", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(None).cast("long").alias("root"))
    return found.unionByName(without)


def _met(docs: DataFrame, n: int, percent: int, text_col: str, order, late: np.ndarray) -> DataFrame:
    """Overlap counts of bundles in the columns of their prefixes (u, v, n, size) and, with v null, the long columns (u, rows); n-grams in ``late`` (ascending) go behind all others."""
    last = docs.sparkSession.sparkContext.broadcast(late)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, _, data, off in tk.chunks(batch.column(0)):
                grams, bundles, sizes = [], [], []
                for s in _sets(data, off, n):
                    if not len(s) or (key := _key(s)) in done:
                        continue
                    done.add(key)
                    p = len(s) - -(-percent * len(s) // 100) + shared_at_least(len(s))
                    rank = order.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
                    if len(last.value):
                        at = np.minimum(np.searchsorted(last.value, s), len(last.value) - 1)
                        rank[last.value[at] == s] += 1 << 16
                    grams.append(s[np.argsort(rank, kind="stable")[:p]])
                    bundles.append(_bundle(s))
                    sizes.append(len(s))
                if grams:
                    each = [len(g) for g in grams]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(bundles, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["gram", "bundle", "size"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Overlap counts of the bundles that meet in a task's columns (u, v, count, smaller size), summed within a batch; long columns (gram, null, rows, 0)."""
        rest = tuple(np.zeros(0, np.int64) for _ in range(3))
        long_gram = None

        def summed(u, v, count, size):
            u, v = np.maximum(u, v), np.minimum(u, v)
            order = np.lexsort((v, u))
            u, v, count, size = u[order], v[order], count[order], size[order]
            first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)])
            if not len(first):
                return u, v, count, size
            return u[first], v[first], np.minimum(np.add.reduceat(count, first), SURE), np.minimum.reduceat(size, first)

        def columns(g, k, s, last: bool):
            """The pairs of whole columns, those that are long with their rows, and the rows of the last column unless it is whole too."""
            nonlocal long_gram
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            g, k, s = g[new], k[new], s[new]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            each = np.diff(np.append(begin, len(g)))
            longer = (each > SHORT) | (g[begin] == long_gram if long_gram is not None else np.zeros(len(begin), bool))
            tail = (g[:0], k[:0], s[:0])
            if not last:
                tail = (g[-1:], k[-1:], s[-1:]) if longer[-1] else (g[begin[-1] :], k[begin[-1] :], s[begin[-1] :])
                long_gram = g[-1] if longer[-1] else None
                if not longer[-1]:
                    begin, each, longer = begin[:-1], each[:-1], longer[:-1]
            row_longer = np.repeat(longer, each)
            m = len(row_longer)
            known, rows = g[begin][longer], each[longer]
            # long columns: chains by size
            at = np.flatnonzero(row_longer[: max(0, m - 1)] & (g[: max(0, m - 1)] == g[1:m]))
            at = at[(100 * s[at] >= percent * s[at + 1]) & (k[at] != k[at + 1])]
            pairs = [(k[at], k[at + 1], np.full(len(at), SURE), s[at])]
            # short ones: a bundle's rows as one, of its least and largest size
            at = np.flatnonzero(~row_longer)
            at = at[np.lexsort((k[at], g[at]))]
            g, k, s = g[at], k[at], s[at]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])[: len(g)])
            if len(first):
                low, high = np.minimum.reduceat(s, first), np.maximum.reduceat(s, first)
                order = np.lexsort((low, g[first]))
                g, k, low, high = g[first][order], k[first][order], low[order], high[order]
                at = np.arange(len(g))
                for j in range(1, SHORT):
                    at = at[at + j < len(g)]
                    at = at[g[at] == g[at + j]]
                    if not len(at):
                        break
                    near = at[100 * high[at] >= percent * low[at + j]]
                    pairs.append((k[near], k[near + j], np.ones(len(near), np.int64), low[near]))
            u, v, count, size = summed(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
            none = np.zeros(len(known), np.int64)
            return tail, pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, known])), pa.concat_arrays([pa.array(v), pa.nulls(len(known), pa.int64())]), pa.array(np.concatenate([count, rows])), pa.array(np.concatenate([size, none]))], ["u", "v", "n", "size"])

        for batch in batches:
            now = tuple(np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate(rest))
            if len(now[0]):
                rest, out = columns(*now, False)
                yield out
        if len(rest[0]):
            yield columns(*rest, True)[1]

    entries = docs.select(F.col(text_col).alias("text")).mapInArrow(prefixes, "gram bigint, bundle bigint, size int")
    return entries.repartition("gram").sortWithinPartitions("gram", "size", "bundle").mapInArrow(met, "u bigint, v bigint, n bigint, size bigint")


def _long_columns(met: DataFrame) -> np.ndarray:
    """N-grams of long columns, ascending: those of most rows, where there are very many."""
    found = met.where("v is null").groupBy("u").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "u").limit(LATE)
    return np.sort(found.select("u").toArrow().column(0).to_numpy().view(np.uint64))


def _placed(met: DataFrame, classes: DataFrame) -> tuple[DataFrame, int, int, bool]:
    """The sets of all families with the block pairs that want them, how many n-grams these take in all, how many the sets have, and whether the table is small."""
    pairs = met.where("v is not null").groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("size").alias("size")).where(F.col("n") >= shared_at_least(F.col("size"))).select("u", "v")
    family = tk.cut(graph.components(pairs, "jaccard-families"), "jaccard-family")

    # a bundle of several sets is a family, too
    bundles = classes.groupBy("bundle").agg(F.count("*").alias("of"))
    family = tk.cut(bundles.join(family, bundles.bundle == family.node, "left").where("root is not null or of > 1").select("bundle", "of", F.coalesce("root", "bundle").alias("fam")), "jaccard-bundles")
    members = tk.spread_join(classes, family, "bundle", "of")
    # blocks: a family that is small is one; else by size class and hash
    members = tk.cut(members.select("key", "fam", "n_grams", "copies", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), F.floor(F.log(CLASS_BASE, F.col("n_grams"))).cast("int").alias("cls")), "jaccard-members")
    blocks = members.groupBy("fam", "cls").agg(F.sum("n_grams").alias("grams"), F.count("*").alias("docs"))
    per = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("int")
    plan = blocks.withColumn("salts", per).groupBy("fam").agg(F.map_from_entries(F.collect_list(F.struct("cls", "salts"))).alias("salts"), F.sum("grams").alias("grams"), F.sum("docs").alias("docs"))  # a family has a few size classes
    plan = plan.select("fam", "docs", F.when((F.col("grams") > BLOCK_GRAMS) | (F.col("docs") > BLOCK_DOCS), F.col("salts")).alias("salts"))
    placed = tk.spread_join(members, tk.cut(plan, "jaccard-plan"), "fam", "docs").withColumn("own", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.col("key"), F.element_at("salts", F.col("cls"))).cast("int")))
    up = lambda c: F.coalesce(F.try_element_at("salts", F.col("cls") + c), F.lit(0))
    upto = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, i, b, j, side: F.struct(a.cast("int").alias("a"), i.cast("int").alias("i"), b.cast("int").alias("b"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    cls, own = F.col("cls"), F.col("own")
    within = F.transform(upto(up(0)), lambda j: pair(cls, F.least(own, j), cls, F.greatest(own, j), (own > j)))
    above = F.transform(upto(up(1)), lambda j: pair(cls, own, cls + 1, j, F.lit(0)))
    below = F.transform(upto(up(-1)), lambda j: pair(cls - 1, j, cls, own, F.lit(1)))
    where = F.when(F.col("salts").isNull(), F.array(pair(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0)))).otherwise(F.concat(within, above, below))
    placed = tk.cut(placed.select(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"), "key", "fam", "copies", "n_grams", where.alias("pairs")), "jaccard-placed")
    size = F.size("pairs")
    sums = placed.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n_grams") * size, F.col("n_grams"), 48 + 32 * size)]).first()
    return placed, sums[0], sums[1], sums[2] <= PLACED_BYTES


def _multiplied(docs: DataFrame, placed: DataFrame, wanted: int, held: int, few: bool, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The links of all block pairs, see ``edges``: in rounds, none of which shuffles much more than the sets' texts."""
    texts = docs.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(text_col).alias("d_hash"), F.col(text_col).alias("text"))
    # a bit set of fixed size, broadcast, keeps most other texts out of the shuffle; it may let some through, never the reverse
    slot = lambda h: F.pmod(h, F.lit(1 << FILTER_BITS))
    marks = placed.groupBy(F.floor(slot(F.col("m_hash")) / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(m_hash, 64) as int))")).alias("mask"))
    texts = texts.withColumn("word", F.floor(slot(F.col("d_hash")) / 64)).join(F.broadcast(marks), "word").where(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, cast(pmod(d_hash, 64) as int))")) != 0).drop("word", "mask")
    number = lambda p: F.xxhash64("fam", p.a, p.i, p.b, p.j)
    rounds = max(1, -(-wanted // max(ROUND_GRAMS, WIDE * held)))

    def flat(r: int) -> DataFrame:
        part = placed if rounds == 1 else placed.withColumn("pairs", F.filter("pairs", lambda p: F.pmod(number(p), F.lit(rounds)) == r)).where(F.size("pairs") > 0)
        found = texts.join(F.broadcast(part) if few else part, F.col("d_id").eqNullSafe(F.col("m_id")) & (F.col("d_hash") == F.col("m_hash"))).select("key", "fam", "copies", F.explode("pairs").alias("p"), "text")
        return found.select(F.xxhash64("fam", "p.a", "p.i", "p.b", "p.j").alias("pair"), (F.struct("p.a", "p.i") == F.struct("p.b", "p.j")).alias("self"), "p.side", "key", "copies", "text")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(keys, copies, sides, sets, alone):
            """A block pair's links as a forest (u, v) and, with v null, each row's number of links (copies of its partners)."""
            keys, copies, sides = np.array(keys, np.int64), np.array(copies, np.int64), np.array(sides)
            _, once = np.unique(keys, return_index=True)  # repeated rows
            groups = [once] if alone else [once[sides[once] == 0], once[sides[once] == 1]]
            if min(map(len, groups)) < (2 if alone else 1):
                return None
            parts = [[sets[i] for i in g] for g in groups]
            size = [np.array([len(s) for s in p], np.int64) for p in parts]
            linked = _links(product(parts[0], parts[1] if not alone else None), size[0], size[-1], percent)
            if alone:
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            node, root = graph.labels(keys[groups[0][a]], keys[groups[-1][b]])
            node, root = node[node != root], root[node != root]
            degrees = [(groups[0], linked @ copies[groups[-1]])] + ([] if alone else [(groups[1], copies[groups[0]] @ linked)])
            row, n_links = (np.concatenate(x) for x in zip(*[(keys[g][n > 0], n[n > 0]) for g, n in degrees], strict=True))
            first, last = pa.array(np.concatenate([node, row])), pa.concat_arrays([pa.array(root), pa.nulls(len(row), pa.int64())])
            return pa.RecordBatch.from_arrays([first, last, pa.array(np.concatenate([np.zeros(len(node), np.int64), n_links]))], ["u", "v", "n"])

        current, keys, copies, sides, sets, alone = None, [], [], [], [], True
        for batch in batches:
            pair, self_, side, key, copy = (batch.column(i).to_pylist() for i in range(5))
            at = 0
            for _, _, data, off in tk.chunks(batch.column(5)):
                for s in _sets(data, off, n):
                    if pair[at] != current:
                        if len(keys) > 1 and (out := edges(keys, copies, sides, sets, alone)) is not None:
                            yield out
                        current, keys, copies, sides, sets, alone = pair[at], [], [], [], [], self_[at]
                    keys.append(key[at])
                    copies.append(copy[at])
                    sides.append(side[at])
                    sets.append(s)
                    at += 1
        if len(keys) > 1 and (out := edges(keys, copies, sides, sets, alone)) is not None:
            yield out

    links = None
    for r in range(rounds):
        now = tk.cut(flat(r).repartition("pair").sortWithinPartitions("pair").mapInArrow(multiplied, "u bigint, v bigint, n bigint"), "jaccard-edges")
        links = now if links is None else links.unionByName(now)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: that of the smallest id (nulls last; of rows that repeat it, the first by text hash; of rows equal in both, any one).  Documents without a set all stay."""
    found = _classified(docs, id_col=id_col, text_col=text_col, **options).where("root is not null")
    each = found.groupBy("root", "id", "text_hash").agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    first = tk.cut(first, "jaccard-first")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = tk.cut(tk.spread_join(each, first, "root", "rows").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), stays.alias("__stays"), "n").where("not __stays or n > 1").drop("n"), "jaccard-gone")
    same = lambda rows: docs[id_col].cast("long").eqNullSafe(rows["__id"]) & (F.xxhash64(docs[text_col]) == rows["__hash"])
    gone = tk.small(marked)
    kept = docs.join(gone, same(gone), "left_anti")
    repeated = marked.where("__stays")
    if repeated.isEmpty():
        return kept
    repeated = tk.small(repeated)
    once = docs.join(repeated, same(repeated), "inner").dropDuplicates(["__id", "__hash"]).drop("__id", "__hash", "__stays")
    return kept.unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def brute(texts: dict[int, str | None], n: int = N, percent: int = PERCENT) -> dict[int, tuple[int, int, int]]:
    """All pairs, for tests: id -> (size, component, number of links)."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    n_links = dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                n_links[i] += 1
                n_links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i), n_links[i]) for i in ids}


#: For tables of distinct ids: all pairs that share a shingle, then reachability.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from o join n p on x = p.doc_id join n q on y = q.doc_id where 100 * c >= 75 * (p.n + q.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as root from documents union select e.y, r.root from r join e on r.doc_id = e.x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(k, 0)::bigint as n_links from (select doc_id, min(root) as component_id from r group by doc_id) left join n using (doc_id) left join (select x as doc_id, count(*) as k from e group by x) using (doc_id)
"""
