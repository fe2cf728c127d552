"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of many documents at once: a chunk is the
concatenated bytes of some whole documents plus their offsets, so no Python
code runs per word.  Hashes are 64-bit; two different words (or windows) of one
corpus share a hash with probability about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another libc: memory stays with the worker
    _LIBC = None

_U = np.uint64
CHUNK_BYTES = 1 << 19

#: Bytes that separate words in the two word definitions in use.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACE_WORD = ~WHITE  # [^\x20\x09-\x0D]
ALNUM_WORD = np.zeros(256, bool)  # digits, a-z, A-Z and everything beyond ASCII
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
NOT_CONT = (np.arange(256) & 0xC0) != 0x80

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[LOWER]
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(int(_P), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, CHUNK_BYTES + 1)
        a, b = np.full(m, _P), np.full(m, _P_INV)
        a[0] = b[0] = _U(1)
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def plain(column: pa.Array) -> pa.Array:
    """The column without nulls (null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents ``lo:hi`` with their bytes and offsets, at most ``limit`` bytes unless one document is longer."""
    column = plain(column)
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    trim()


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system (workers live on between tasks)."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no document border: starts, ends, and the first run of each document (n + 1 numbers)."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first[n] = True
    begin = member.copy()
    begin[1:] &= ~member[:-1] | first[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of the bytes of each span; ``lower`` folds A-Z."""
    n = len(data)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a document, and the word each starts at."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, _U(k))
    for j in range(k):
        h += words[j : j + m] * _STEP[j]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:m] == doc[k - 1 : k - 1 + m])
    return mix(h[at]), at


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in document order and the first shingle of each document; a document of fewer than k words (but some) has its whole sequence as one."""
    h, at = windows(words, first, k)
    n = np.diff(first)
    per = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    bounds = np.concatenate([[0], np.cumsum(per)])
    if len(short):
        whole = np.array([mix(np.array([(words[first[d] : first[d + 1]] * _STEP[: n[d]]).sum() + _U(n[d])], np.uint64))[0] for d in short], np.uint64)
        h = np.insert(h, bounds[short], whole)
        per[short] = 1
        bounds = np.concatenate([[0], np.cumsum(per)])
    return h, bounds


def counts(member: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many True values each document has."""
    total = np.zeros(len(member) + 1, np.int64)
    np.cumsum(member, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def normalised(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


#: bytes.translate table: A-Z folded, bytes that are in no alphanumeric word made spaces.
ALNUM_TABLE = bytes(int(LOWER[b]) if ALNUM_WORD[b] else 0x20 for b in range(256))


def shared_folder(spark, purpose: str) -> str:
    """A new folder (URI) below the checkpoint folder that the cluster names; a local one is set only where none is and Spark runs on this machine alone (as in tests)."""
    import tempfile

    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    if "://" not in root:
        root = ("file://" if root.startswith("/") else "file:///") + root
    return f"{root.rstrip('/')}/quern-{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark) -> Iterator[None]:
    """Shuffle files of the queries within go when each of them ends, not when their plans are collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df, purpose: str):
    """The rows written to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000


def small(df, rows: int = BROADCAST_ROWS):
    """The (narrow, written) table marked for broadcast if it has at most so many rows; else Spark joins it as it finds best."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df


HOT_KEYS = 4_000


def spread_join(rows, table, key: str, copies: str):
    """The inner join of rows with a written table of one row per key that says, in ``copies``, how many of the rows have it at most.

    Keys with more than max(4, total / HOT_KEYS) rows, fewer than HOT_KEYS whatever the data, are broadcast and their
    rows stay where they are; no other key is a large part of a shuffle partition.
    """
    from pyspark.sql import functions as F

    most = max(4, (table.agg(F.sum(copies)).first()[0] or 0) // HOT_KEYS)
    hot = table.where(F.col(copies) > most)
    rare = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rare.join(table.where(F.col(copies) <= most), key))


BATCH_ROWS = 1000


def modest_batches(df, rows: int = BATCH_ROWS) -> None:
    """Makes the session's Arrow batches small enough for long texts (they are held several times over, on both sides)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
