"""Vector code compression (13): product codes whose codebooks come from Lloyd rounds with Hamerly's bounds.

Vectors become integers (the floor of ``scale`` times each component) and are
cut into equal parts, each with a codebook of its own.  A row persists, for
every part, its entry, one upper bound of the distance to that entry and one
lower bound of the distance to the second nearest.  After the entries have
moved, the upper bound grows by what its entry moved and the lower one shrinks
by the longest move of any other; only where the upper bound is then not
strictly below the lower one is the exact distance taken, and only where that
fails too are all entries scanned, in integers, the lower index winning ties.
A bound that is met exactly could hide a tie, so it never saves a scan.  Bounds
are stored as 32-bit floats, rounded outward.

Every round is one pass that writes the rows' new state beside each task's
sums by entry, and one aggregation of these (a row for each entry and task,
summed before they are shuffled).  Only the codebooks, of a size fixed by the
parameters, come to the driver.

Defined results: rows whose vector is null, or holds a null or a component
that is not finite, are no rows of the result; nor are those whose length is
not that of the kept vector of the smallest id, or no multiple of the parts, or
that hold a component beyond LARGEST (their squares would not fit in 64 bits).
Repeated rows and ids are rows of their own; null ids come last in the choice
of the first entries, and equal ids by vector; fewer kept vectors than entries
make smaller codebooks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 2.0**20
BLOCK_ROWS = 2048
STATE = "id bigint, label string, vector binary, code binary, upper binary, lower binary"
MOVED = "slot int, n bigint, sums array<bigint>"


@dataclass
class Codes:
    """``rows``: (id, label, code, error), label as text; ``codebooks``: integers by part, entry and position; ``scans``: part scans of each pass."""

    rows: DataFrame
    codebooks: np.ndarray
    scans: list[int]


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _kept(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vectors have only numbers of a size that can be squared."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(x.cast("double")))
    return vectors.where(v.isNotNull() & fine)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals), its squared distance and that of the second nearest (of one entry alone: none is near)."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d += (x[:, k, None] - book[None, :, k]) ** 2
    at = d.argmin(1)
    row = np.arange(len(x))
    near = d[row, at]
    if d.shape[1] == 1:
        return at, near, np.full(len(x), np.inf)
    d[row, at] = np.iinfo(np.int64).max
    return at, near, d.min(1)


def _assign(x: np.ndarray, books: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, moves: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries, upper and lower bounds of all parts of x (rows, parts, length), and how many parts were scanned."""
    n, parts, _ = x.shape
    code = np.zeros((n, parts), np.uint8)
    upper, lower = np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
    scanned = 0
    for p in range(parts):
        scan = np.arange(n)
        if state is not None:
            at = state[0][:, p]
            longest = np.argsort(moves[p])[::-1][:2]
            other = moves[p][np.where(at == longest[0], longest[-1], longest[0])] if len(moves[p]) > 1 else np.zeros(n, np.float32)
            high, low = _above(state[1][:, p] + moves[p][at]), _below(state[2][:, p] - other)
            loose = np.flatnonzero(~(high < low))  # only there is the exact distance taken
            high[loose] = _above(np.sqrt(_squares(x[loose, p], books[p][at[loose]])))
            code[:, p], upper[:, p], lower[:, p] = at, high, low
            scan = loose[~(high[loose] < low[loose])]
        if len(scan):
            at, near, second = _scan(x[scan, p], books[p])
            code[scan, p], upper[scan, p], lower[scan, p] = at, _above(np.sqrt(near)), _below(np.sqrt(second))
            scanned += len(scan)
    return code, upper, lower, scanned


def _numbers(column: pa.Array, shape: tuple[int, ...], kind) -> np.ndarray:
    """A column of equally long lists or binaries as one array."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(shape)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _pass(rows: DataFrame, books: np.ndarray, moves: np.ndarray | None, last: bool, purpose: str) -> DataFrame:
    """One written assignment: state rows (of the last one with their errors) and, with slot not null, the tasks' sums by entry and (slot -1) their number of scans."""
    shared = rows.sparkSession.sparkContext.broadcast((books, moves))
    parts, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = shared.value
        sums, count, scans = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(lo, BLOCK_ROWS)
                n = batch.num_rows
                x = _numbers(batch.column(2), (n, parts, length), np.int32).astype(np.int64)
                state = None if moves is None else (_numbers(batch.column(3), (n, parts), np.uint8), *(_numbers(batch.column(i), (n, parts), np.float32) for i in (4, 5)))
                code, upper, lower, scanned = _assign(x, books, state, moves)
                error = pa.array(_squares(x, books[np.arange(parts), code]).sum(1)) if last else pa.nulls(n, pa.int64())
                slot = (np.arange(parts) * entries + code).ravel()
                np.add.at(sums, slot, x.reshape(-1, length))
                count += np.bincount(slot, minlength=len(count))
                scans += scanned
                none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
                state = [_blobs(x.astype(np.int32).reshape(n, -1)), _blobs(code), _blobs(upper), _blobs(lower)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *state, error, *none], names)
        used = np.flatnonzero(count)
        m = len(used) + 1
        totals = [pa.array([*used.tolist(), -1], pa.int32()), pa.array([*count[used].tolist(), scans], pa.int64()), pa.array([*sums[used].tolist(), []], pa.list_(pa.int64()))]
        kinds = [pa.int64(), pa.string(), *[pa.binary()] * 4, pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in kinds), *totals], names)

    names = ["id", "label", "vector", "code", "upper", "lower", "error", "slot", "n", "sums"]
    return tk.cut(rows.mapInArrow(run, f"{STATE}, error bigint, {MOVED}"), purpose)


def _moved(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The next codebooks (floors of the means; unused entries stay), how far each entry moves at most, and the scans."""
    parts, entries, length = books.shape
    found = state.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.try_element_at("sums", F.lit(k + 1))).alias(f"s{k}") for k in range(length)])
    new, scans = books.copy(), 0
    for r in found.collect():  # parts x entries rows
        if r.slot < 0:
            scans = r.n
        else:
            new[divmod(r.slot, entries)] = [r[f"s{k}"] // r.n for k in range(length)]
    return new, _above(np.sqrt(((new - books) ** 2).sum(2))), scans


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None
) -> Codes:
    """Codes of all kept vectors after ``rounds`` rounds; at most 256 entries."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, at least one part, no negative rounds")
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    given = _kept(vectors, vector_col).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), integers(F.col(vector_col), scale).alias("vector"))
    least = given.orderBy(F.asc_nulls_last("id"), "vector").limit(1).collect()
    length = len(least[0].vector) if least else 0
    if not length or length % parts:
        empty = given.limit(0).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return Codes(empty, np.zeros((parts, 0, 0), np.int64), [])
    given = given.where(F.size("vector") == length)
    first = [r.vector for r in given.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()]
    books = np.ascontiguousarray(np.array(first, np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2))
    none = F.lit(None).cast("binary")
    rows, moves, scans = given.select("id", "label", "vector", none.alias("code"), none.alias("upper"), none.alias("lower")), None, []
    for r in range(rounds + 1):
        state = _pass(rows, books, moves, r == rounds, f"codes-{r}")
        new, far, n = _moved(state, books)
        scans.append(n)
        if r == rounds:
            return Codes(state.where("slot is null").select("id", "label", "code", "error"), books, scans)
        books, moves = new, far
        rows = state.where("slot is null").select("id", "label", "vector", "code", "upper", "lower")
    raise AssertionError


def decoded(code: Column, codebooks: np.ndarray) -> Column:
    """The integer vector that a code stands for."""
    parts, entries, length = codebooks.shape
    words = [F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in codebooks]
    at = lambda p: F.conv(F.substring(F.hex(code), 2 * p + 1, 2), 16, 10).cast("int") + 1
    return F.concat(*[F.element_at(words[p], at(p)) for p in range(parts)])


def with_label_errors(codes: Codes) -> DataFrame:
    """The rows with ``label_error``, the sum of errors of a label's rows (rows without a label together); a label may hold any share of the rows."""
    key = F.concat(F.when(F.col("label").isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce("label", F.lit("")))
    keyed = codes.rows.withColumn("key", key)
    sums = tk.cut(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies")), "codes-labels")
    return tk.spread_join(keyed, sums, "key", "copies").drop("key", "copies")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    codes = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col="label")
    return with_label_errors(codes).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codes.codebooks)).alias("codebooks_sha256"))


def brute(vectors: list[list[int]], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[list[int]], list[int], list]:
    """Plain rounds over integer vectors in order of id, for tests: codes, errors, codebooks."""
    cut = [[v[i * len(v) // parts : (i + 1) * len(v) // parts] for i in range(parts)] for v in vectors]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda j: (far(v[p], books[p][j]), j)) for p in range(parts)] for v in cut]  # noqa: B023
        if r == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                if own := [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == j]:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return codes, [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)], books


def _oracle() -> str:
    """The rounds unrolled; x: part rows, c: entries, a: assignments."""
    sql = """
with k as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] as x from k, (select unnest(range(16)) as p)),
c0 as (select p, r - 1 as e, x as c from x where r <= 64)"""
    near = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        sql += f",\na{i} as materialized (select r, p, x, min_by(e, d * 64 + e) as e, min(d)::bigint as d from (select r, p, x, e, {near} as d from x join c{i} using (p)) group by r, p, x)"
        if i < ROUNDS:
            sql += f",\ns{i} as (select p, e, i, (sum(y) - (((sum(y) % count(*)) + count(*)) % count(*)))::hugeint // count(*) as y from (select p, e, unnest(x) as y, generate_subscripts(x, 1) as i from a{i}) group by p, e, i),\nc{i + 1} as (select c.p, c.e, coalesce(s.c, c.c) as c from c{i} c left join (select p, e, list(y::bigint order by i) as c from s{i} group by p, e) s using (p, e))"
    return sql + f""",
o as (select r, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by r),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from o join k using (r), h"""


ORACLE = _oracle()
