"""SimHash near-duplicates (12): fingerprints that differ in few bits, found by anchors of a covering code.

A fingerprint of 64 bits has two blocks of 31 and two bits more.  Of two
fingerprints that differ in at most three bits, one block differs in at most
one (pigeonhole), so each block is searched for a threshold of one.  The
anchors of a block are the 2**26 words of the Hamming code of length 31: every
block is within the covering radius, one bit, of exactly one of them.  Each
fingerprint is replicated to all anchors within radius plus threshold, two bits:
to one of distance one (or none, where it is a code word itself) and 15 of
distance two, whatever the data.  Blocks that differ in at most one bit so meet
at the anchor of either.  The code on all 64 bits with a threshold of three
would need some 10,000 anchors for each fingerprint.

At an anchor all 64 bits are compared.  Fingerprints are replicated once,
whatever the number of documents that have them, and an anchor gives a forest,
not its pairs.  Anchors of more than BLOCK fingerprints are cut into blocks
whose pairs are compared apart, so that no task holds an anchor whole.

Defined results: null and empty texts, and those without words, have the
fingerprint zero and link like any other; fewer words than a shingle are one
shingle; repeated rows and ids are rows of their own; a component's id is its
smallest that is not null (null where all are); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import graph
from quern.llm import textkernel as tk

N = 3
BITS = 3
SEED = 42
BLOCK = 4096  # fingerprints of an anchor that are compared at once
SMALL = 48  # up to so many are compared by shifting whole columns
LENGTH = 31
HASHES = 1 << 16  # hashes held at a time

_U = np.uint64
#: Fixed by the Hamming code: the syndrome of a block is the exclusive or of the numbers (from 1) of its set bits.
_SYNDROME = np.zeros((4, 256), np.uint8)
for _byte in range(4):
    for _bit in range(8):
        _SYNDROME[_byte, (np.arange(256) >> _bit & 1).astype(bool)] ^= 8 * _byte + _bit + 1
#: For each syndrome, the flips that lead to the code words within two bits: of one bit, and of 15 pairs of bits.
_FLIPS = np.zeros((32, 16), np.uint64)
for _s in range(1, 32):
    _FLIPS[_s] = [1 << (_s - 1)] + [1 << (i - 1) | 1 << ((i ^ _s) - 1) for i in range(1, 32) if i < i ^ _s]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), HASHES):
        total += np.unpackbits(hashes[lo : lo + HASHES, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, n: int = N) -> int:
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    total, m = np.zeros(64, np.int64), len(words) - k + 1
    for lo in range(0, m, HASHES):
        hi = min(m, lo + HASHES)
        total += _bits(np.array([digest(joined[i:j], SEED) for i, j in zip(starts[lo:hi], ends[lo + k - 1 : hi + k - 1], strict=True)], np.uint64))
    return int(np.packbits(2 * total > m, bitorder="little").view(np.uint64)[0])


#: A-Z folded; bytes.split() then cuts at the six white bytes only.
_FOLD = bytes(int(x) for x in tk.LOWER)


def fingerprints(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits."""
    tk.modest_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            out = []
            for lo, hi, data, off in tk.chunks(batch.column(1)):
                body = data.tobytes()
                for d in range(hi - lo):
                    text = body[off[d] : off[d + 1]]
                    if (fp := known.get(text)) is None:
                        fp = known[text] = fingerprint(text, n)
                    out.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint): all code words within two bits of either block; an anchor's lowest bit tells the block."""
    anchors, owners = [], []
    for block in range(2):
        x = fp >> _U(LENGTH * block) & _U((1 << LENGTH) - 1)
        s = np.zeros(len(x), np.uint8)
        for byte in range(4):
            s ^= _SYNDROME[byte, (x >> _U(8 * byte) & _U(255)).astype(np.int64)]
        flips = _FLIPS[s]
        near = np.ones(flips.shape, bool)
        near[s == 0, 1:] = False  # a code word is its own anchor; the next ones differ in three bits
        anchors.append(((x[:, None] ^ flips) << _U(1) | _U(block))[near])
        owners.append(np.broadcast_to(fp[:, None], flips.shape)[near])
    return np.concatenate(anchors).view(np.int64), np.concatenate(owners).view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= bits


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of an anchor as stars."""
    u, v = [], []
    fp = np.unique(fp)
    for lo in range(0, len(fp), 256):
        i, j = np.nonzero(_near(fp[lo : lo + 256, None], fp[None, :], bits))
        i += lo
        node, root = graph.labels(fp[i[i < j]], fp[j[i < j]])
        u.append(node)
        v.append(root)
    node, root = graph.labels(np.concatenate(u), np.concatenate(v))
    return node[node != root], root[node != root]


def compared(bits: int = BITS):
    """Rows (key, fp), sorted by key, to links (u, v): stars, no more rows than fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def links(key, fp):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            each = np.diff(np.append(first, len(key)))
            u, v = [], []
            small = np.flatnonzero(np.repeat(each <= SMALL, each))
            for j in range(1, SMALL):
                small = small[small + j < len(key)]
                small = small[key[small] == key[np.minimum(small + j, len(key) - 1)]]
                if not len(small):
                    break
                near = small[_near(fp[small], fp[small + j], bits)]
                u.append(fp[near])
                v.append(fp[near + j])
            for i in np.flatnonzero(each > SMALL):
                node, root = _forest(fp[first[i] : first[i] + each[i]], bits)
                u.append(node)
                v.append(root)
            node, root = graph.labels(*(np.concatenate([*x, rest[0][:0]]) for x in (u, v)))
            return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["u", "v"])

        for batch in batches:
            key, fp = (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
            if not len(key):
                continue
            at = int(np.searchsorted(key, key[-1]))  # the last key may go on
            rest = (key[at:], fp[at:])
            if at:
                yield links(key[:at], fp[:at])
        if len(rest[0]):
            yield links(*rest)

    return run


def join(docs: DataFrame, n: int = N, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of every row; fingerprints link where at most ``bits`` (three at most) differ."""
    if not 0 <= bits <= BITS:
        raise ValueError("blocks of this code find links of up to three bits")
    rows = tk.cut(fingerprints(docs, n, id_col, text_col), "simhash-rows")
    classes = tk.cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "simhash-fingerprints")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, fp = replicas(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp)], ["anchor", "fp"])

    near = classes.select("fp").mapInArrow(dealt, "anchor bigint, fp bigint")
    hot = tk.cut(near.groupBy("anchor").count().where(F.col("count") > BLOCK).select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "simhash-hot")
    # hot anchors hold more than BLOCK replicas each
    if hot.isEmpty():
        keyed = near.select(F.col("anchor").alias("key"), "fp")
    else:
        mine = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("anchor", F.least(j, mine), F.greatest(j, mine)))
        keyed = near.join(tk.small(hot), "anchor", "left").select(F.explode(F.when(F.col("blocks").isNull(), F.array("anchor")).otherwise(pairs)).alias("key"), "fp")
    links = tk.cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compared(bits), "u bigint, v bigint"), "simhash-links")
    roots = tk.cut(graph.components(links, "simhash-components"), "simhash-roots")
    lowest = roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("least").alias("component"))
    reached = roots.join(lowest, "root").select(F.col("node").alias("fp"), "component", F.lit(True).alias("linked"))
    whole = classes.join(reached, "fp", "left").select("fp", "copies", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component"))
    return tk.spread_join(rows, tk.cut(whole, "simhash-classes"), "fp", "copies").select("id", "fp", "component")


def query(spark, sf_dir: str) -> DataFrame:
    found = join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def brute(texts: dict[int, str | None], n: int = N, bits: int = BITS) -> dict[int, tuple[str, int]]:
    """All pairs, for tests: id -> (fingerprint, component)."""
    import re

    prints = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(w[j : j + n]) for j in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), SEED) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    out = {}
    for i in sorted(prints):
        if i in out:
            continue
        todo = [i]
        out[i] = i
        while todo:
            a = todo.pop()
            for b in prints:
                if b not in out and (prints[a] ^ prints[b]).bit_count() <= bits:
                    out[b] = i
                    todo.append(b)
    return {i: (f"{prints[i]:016x}", out[i]) for i in prints}
