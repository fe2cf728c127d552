"""LM scoring (9): an n-gram trie with Elias-Fano pointers.

The trie has one level for each order.  A node of level k is a successor word of
a context, which is a node of level k - 1, by number; a level lists contexts in
order and each context's successors, by word number, together.  A level is kept
in shards of bounded size, each a file that executors map into memory:

*   where each context's successors begin, monotone pointers in Elias-Fano form
    (unary high bits with a rank directory, packed low bits),
*   the successors' word numbers, packed to their bits,
*   the smoothed log10 probability of each node in one byte,
*   the backoff weight of each context in one byte.

A query reads its context's range by two selects and finds the word in it by
interpolation (word numbers are hashes' ranks, so they are spread evenly), for the
tokens of many texts at once and once for each distinct n-gram, with its
probability, so that a shard is gone to once for all of them.  Probabilities
are those of interpolated absolute discounting; the unigram level, found by
word hash, is the exact (c + 0.5) / (N + 0.5 (V + 1)).

Counting is map-side first: a task turns its texts into sorted distinct
integers with counts and sends delta-coded, compressed runs of them, not rows.
Runs are dealt by expected mass on every level, so that a frequent context is
split over several shards.

Defined results: null and empty texts are their end token alone; a null id
counts as training; with no training text at all every token is unknown;
repeated rows count and are scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk
from quern.llm.sstable import filesystem

_U = np.uint64
ORDER = 3
DISCOUNT = 0.75
LOWEST = -12.0  # log10 of the smallest probability that a byte holds
RANGE_TOKENS = 2_000_000  # expected n-gram tokens of a shard
OPEN_FILES, OPEN_BYTES = 512, 300_000_000  # shards that a worker keeps open
HOLD = 2_500_000  # n-gram tokens that a task counts at once
CHUNK = 1 << 20
AT_ONCE = 600_000  # tokens that are looked up together: the more shards there are, the fewer of a text's n-grams lie in one
END = tk.mix(np.array([0xE5D], np.uint64))[0]  # the end token's hash


# -- sorting ------------------------------------------------------------------------------------------------


def ordered(keys: np.ndarray) -> np.ndarray:
    """An order that makes 64-bit integers ascend: they are sorted by value, which is several times faster than by place, with their places in the low bits."""
    n = len(keys)
    if n < 2:
        return np.arange(n)
    base = keys.min()
    rest = (keys - base).astype(np.uint64)
    room = (n - 1).bit_length()
    lost = max(0, int(rest.max()).bit_length() + room - 64)  # low bits of the integers that find no room
    order = (np.sort((rest >> _U(lost)) << _U(room) | np.arange(n, dtype=np.uint64)) & _U((1 << room) - 1)).astype(np.int64)
    if lost:
        rest = rest[order]
        high = rest >> _U(lost)
        same = high[1:] == high[:-1]
        mixed = same & (rest[1:] != rest[:-1])
        if mixed.any():  # runs of equal high bits that hold different integers
            run = np.cumsum(np.concatenate([[0], ~same]))
            at = np.flatnonzero(np.isin(run, run[1:][mixed], kind="table"))
            order[at] = order[at][np.argsort(rest[at])]
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different integers, ascending, and where each one stands among them."""
    order = ordered(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], back


# -- Elias-Fano and packed integers -------------------------------------------------------------------------


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits each, one after the other, in 64-bit words (and one word more)."""
    out, step = [], 1 << 16  # a step fills whole words
    for lo in range(0, len(values), step):
        raw = (values[lo : lo + step, None] >> np.arange(bits, dtype=np.uint64)) & _U(1)
        out.append(np.packbits(raw.astype(np.uint8).ravel(), bitorder="little"))
    raw = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view(np.uint64)


def unpack(words: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * _U(bits)
    word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << bits) - 1)


class Pointers:
    """A monotone sequence in Elias-Fano form."""

    def __init__(self, high: np.ndarray, before: np.ndarray, low: np.ndarray, bits: int):
        self.high, self.before, self.low, self.bits = high, before, low, bits

    @staticmethod
    def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(math.log2(most / n))) if n and most > n else 0
        at = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        raw = np.zeros(-(-(int(at[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
        raw[at] = 1
        high = np.packbits(raw, bitorder="little").view(np.uint64)
        before = np.cumsum(np.bitwise_count(high), dtype=np.uint64)
        before = np.concatenate([[0], before[:-1]]).astype(np.uint32 if n < 1 << 32 else np.uint64)  # ones before each word
        return high, before, pack(values & _U((1 << bits) - 1), bits) if bits else np.zeros(1, np.uint64), bits

    def _select(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word of each i-th one, and its bit there: by the directory, then by bytes."""
        word = np.searchsorted(self.before, i.astype(self.before.dtype), "right") - 1
        rest = (i - self.before[word].astype(np.int64)).astype(np.uint8)
        octets = np.asarray(self.high)[word][:, None].view(np.uint8)
        total = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
        which = (total <= rest[:, None]).sum(1)
        row = np.arange(len(i))
        rest = rest - np.where(which > 0, total[row, np.maximum(which - 1, 0)], 0).astype(np.uint8)
        return word, which * 8 + _SELECT[octets[row, which], rest]

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (((place - i).astype(np.uint64) << _U(self.bits)) | unpack(self.low, i, self.bits)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        word, bit = self._select(i)
        return self._value(i, word * 64 + bit)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th numbers and those after them: mostly the next one of the same word."""
        i = i.astype(np.int64)
        word, bit = self._select(i)
        rest = np.asarray(self.high)[word] & ~((_U(2) << bit.astype(np.uint64)) - _U(1))  # bits above
        place = word * 64 + np.bitwise_count((rest & -rest) - _U(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            w, b = self._select(i[far] + 1)
            place[far] = w * 64 + b
        return self._value(i, word * 64 + bit), self._value(i + 1, place)


#: The place of the n-th one of a byte.
_SELECT = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


def _keys_arrays(keys: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of an ascending set of 64-bit integers, searched by ``find``."""
    n = len(keys)
    base = keys[0]
    rest = keys - base
    bits = max(0, int(math.log2(max(1, int(rest[-1]) + 1) / max(1, n // 4))))
    bucket = (rest >> _U(bits)).astype(np.int64)
    pointers = np.searchsorted(bucket, np.arange(int(bucket[-1]) + 2)).astype(np.uint64)
    high, before, low, ef = Pointers.build(pointers)
    return {"meta": np.array([n, base, bits, ef, bucket[-1]], np.uint64), "high": high, "before": before, "low": low, "rest": pack(rest & _U((1 << bits) - 1), bits) if bits else np.zeros(1, np.uint64)}


def find(a: dict[str, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted integer, or -1."""
    n, base, bits, ef, last = (int(x) for x in a["meta"])
    out = np.full(len(wanted), -1, np.int64)
    rest = wanted - _U(base)
    bucket = rest >> _U(bits)
    at = np.flatnonzero((wanted >= _U(base)) & (bucket <= _U(last)))
    if not len(at):
        return out
    rest, bucket = rest[at] & _U((1 << bits) - 1), bucket[at].astype(np.int64)
    lo, hi = Pointers(a["high"], a["before"], a["low"], ef).ranges(bucket)
    while len(at):  # binary search in all buckets at once; those that are done leave
        open_ = lo < hi
        at, rest, lo, hi = at[open_], rest[open_], lo[open_], hi[open_]
        middle = (lo + hi) >> 1
        value = unpack(a["rest"], middle, bits)
        hit = value == rest
        out[at[hit]] = middle[hit]
        less = value < rest
        lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, middle)
        at, rest, lo, hi = at[~hit], rest[~hit], lo[~hit], hi[~hit]
    return out


def level_arrays(context: np.ndarray, word: np.ndarray, words: int) -> dict[str, np.ndarray]:
    """The arrays of ascending (context, word) pairs, searched by ``successor``: pointers by context, packed word numbers."""
    lo, hi = int(context[0]), int(context[-1])
    begin = np.searchsorted(context, np.arange(lo, hi + 2)).astype(np.uint64)
    high, before, low, ef = Pointers.build(begin)
    bits = max(1, (words - 1).bit_length())
    return {"meta": np.array([len(word), lo, hi, bits, ef, words], np.uint64), "high": high, "before": before, "low": low, "words": pack(word.astype(np.uint64), bits)}


def successors(a: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of places that each context (ascending, within the shard) has."""
    pointers = Pointers(a["high"], a["before"], a["low"], int(a["meta"][4]))
    new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(context)])
    each = np.diff(np.append(new, len(context)))
    lo, hi = pointers.ranges(context[new] - int(a["meta"][1]))
    return np.repeat(lo, each), np.repeat(hi, each)


def successor(a: dict[str, np.ndarray], context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of each (context, word), contexts ascending, or -1."""
    _, first, last, bits, _, words = (int(x) for x in a["meta"])
    out = np.full(len(context), -1, np.int64)
    at = np.flatnonzero((context >= first) & (context <= last))
    if not len(at):
        return out
    lo, hi = successors(a, context[at])
    word = word[at]
    left, right = np.full(len(at), -1, np.int64), np.full(len(at), words, np.int64)  # the words that stand before lo and at hi
    step = 0
    going = np.flatnonzero(lo < hi)
    while len(going):  # those that are done leave
        at, word, lo, hi, left, right = (x[going] for x in (at, word, lo, hi, left, right))
        if step % 4 == 3:  # unevenly spread words: by halves now and then
            middle = (lo + hi) >> 1
        else:
            middle = lo + (word - left - 1) * (hi - lo) // (right - left - 1)
        value = unpack(a["words"], middle, bits).astype(np.int64)
        hit = value == word
        out[at[hit]] = middle[hit]
        less = value < word
        lo, left = np.where(less, middle + 1, lo), np.where(less, value, left)
        hi, right = np.where(less, hi, middle), np.where(less, right, value)
        going = np.flatnonzero(~hit & (lo < hi))
        step += 1
    return out


# -- files --------------------------------------------------------------------------------------------------


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """One file: the count of arrays, their names, types and lengths, then their bytes, each from a multiple of 64."""
    import json

    system, base = filesystem(folder)
    head, at = [], 4096
    for k, x in arrays.items():
        head.append((k, x.dtype.str, len(x), at))
        at += -(-x.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    system.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    with system.open_output_stream(temporary) as out:
        out.write(raw.ljust(4096))
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes())
            out.write(b"\0" * (-x.nbytes % 64))
    system.move(temporary, f"{base}/{name}")
    return f"{base}/{name}"


def load(folder: str, path: str) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a file and the bytes of memory they take: none where the file can be mapped, all of it where a remote store holds it."""
    import json
    import mmap

    system, _ = filesystem(folder)
    if system.type_name == "local":
        with open(path, "rb") as f:
            raw, held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), 0
    else:
        with system.open_input_stream(path) as source:
            raw = source.read()
        held = len(raw)
    return {k: np.frombuffer(raw, dtype, n, at) for k, dtype, n, at in json.loads(raw[:4096])}, held


_open: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()


def opened(folder: str, path: str) -> dict[str, np.ndarray]:
    """A shard's arrays; those used longest ago are let go beyond OPEN_FILES mapped files or OPEN_BYTES read ones."""
    if path in _open:
        _open.move_to_end(path)
    else:
        _open[path] = load(folder, path)
        while len(_open) > 1 and (len(_open) > OPEN_FILES or sum(held for _, held in _open.values()) > OPEN_BYTES):
            _open.popitem(last=False)
    return _open[path][0]


class Sharded:
    """An ascending set over several files.  shards: (path, first integer, number of integers), in order.

    With ``words``, a level: its integers are context * words + word, and shards are searched by context.
    """

    def __init__(self, folder: str, shards: list[tuple[str, int, int]], words: int = 0):
        self.folder, self.paths, self.words = folder, [s[0] for s in shards], words
        self.first = np.array([s[1] for s in shards], np.uint64)
        self.base = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).astype(np.int64)

    def arrays(self, k: int) -> dict[str, np.ndarray]:
        return opened(self.folder, self.paths[k])

    def find(self, wanted: np.ndarray, name: str = "", default=0) -> tuple[np.ndarray, np.ndarray | None]:
        """The global places of the wanted integers, or -1; with a name, that array's values there (else the default)."""
        keys, back = distinct(wanted)  # each once, and a shard's together
        out = np.full(len(keys), -1, np.int64)
        value = np.full(len(keys), default) if name else None
        cuts = np.append(np.searchsorted(keys, self.first), len(keys))
        if self.words:
            context = keys // _U(self.words)
            word = (keys - context * _U(self.words)).astype(np.int64)
            context = context.astype(np.int64)
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            here, a = slice(cuts[k], cuts[k + 1]), self.arrays(int(k))
            found = successor(a, context[here], word[here]) if self.words else find(a, keys[here])
            known = np.flatnonzero(found >= 0)
            out[cuts[k] + known] = found[known] + self.base[k]
            if name:
                value[cuts[k] + known] = a[name][found[known]]
        return out[back], value[back] if name else None

    def values(self, name: str, at: np.ndarray, default) -> np.ndarray:
        """An array's values at ascending global places (-1: the default)."""
        out = np.full(len(at), default)
        cuts = np.searchsorted(at, self.base)
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            here = slice(cuts[k], cuts[k + 1])
            out[here] = self.arrays(int(k))[name][at[here] - self.base[k]]
        return out


class Model:
    """Vocabulary and levels; small enough to travel in a closure (paths and bounds only)."""

    def __init__(self, folder: str, words: list[tuple[str, int, int]], total: int):
        self.folder, self.words, self.total, self.levels, self.fixed, self.masses = folder, words, total, [], [], []
        self.word_masses: list[int] = []

    @property
    def size(self) -> int:
        return sum(s[2] for s in self.words)

    def vocabulary(self) -> Sharded:
        return Sharded(self.folder, self.words)

    def level(self, k: int) -> Sharded:
        return Sharded(self.folder, [(p, lo, n) for p, lo, n, *_ in self.levels[k - 2]], self.size)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.size + 1)))

    def backoff(self, k: int, context: np.ndarray) -> np.ndarray:
        """log10 of the weight that level k leaves to the one below, by context (0 where the context has no successor)."""
        out = np.zeros(len(context))
        shards = self.levels[k - 2]
        if shards:
            firsts = np.array([s[3] for s in shards], np.int64)
            which = np.searchsorted(firsts, context, "right") - 1
            opened = self.level(k)
            for s in np.unique(which):
                if s >= 0:
                    at = np.flatnonzero((which == s) & (context <= shards[s][4]))
                    out[at] = _decoded(opened.arrays(int(s))["backoff"][context[at] - shards[s][3]])
            cut, weight = self.fixed[k - 2]
            if len(cut):
                place = np.minimum(np.searchsorted(cut, context), len(cut) - 1)
                at = np.flatnonzero(cut[place] == context)
                out[at] = weight[place[at]]
        return out


def _coded(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10, LOWEST, 0) * (255 / LOWEST)).astype(np.uint8)


def _decoded(code: np.ndarray) -> np.ndarray:
    return code * (LOWEST / 255)


# -- texts to numbers ---------------------------------------------------------------------------------------


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (each document's words, then its end) and each document's first token."""
    starts, ends, first = tk.spans(tk.SPACE_WORD[data], off)
    h = tk.span_hash(data, starts, ends, True)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _delta(values: np.ndarray) -> bytes:
    """Ascending integers: differences, byte planes, zstd."""
    d = np.diff(values, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _undelta(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzip(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def runs_ordered(keys: np.ndarray) -> np.ndarray:
    """The order of two ascending runs."""
    return np.argsort(keys, kind="stable")


def _summed(keys: np.ndarray, counts: np.ndarray, *others: np.ndarray, sort=ordered):
    order = sort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first), *(x[order][first] for x in others)


# -- building -----------------------------------------------------------------------------------------------


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> Model:
    """Counts all given texts and writes the trie's levels to the shared folder."""
    spark = docs.sparkSession
    folder = tk.shared_folder(spark, "ngrams")
    tk.modest_batches(docs)
    given = docs.select(F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, off in tk.chunks(batch.column(0), CHUNK):
                k, c = np.unique(tokens(data, off)[0], return_counts=True)
                keys, counts = _summed(np.concatenate([keys, k]), np.concatenate([counts, c]), sort=runs_ordered) if len(keys) else (k, c)
                if len(keys) > HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "c"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)
        keys = np.concatenate([b.column(0).to_numpy() for b in parts] or [np.zeros(0, np.int64)]).view(np.uint64) ^ _U(1 << 63)  # signed order to unsigned
        if len(keys):
            part = TaskContext.get().partitionId()
            counts = np.concatenate([b.column(1).to_numpy() for b in parts])
            path = save(folder, f"words-{part:07d}", _keys_arrays(keys) | {"counts": counts, "mass": np.cumsum(counts)})
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "first": str(int(keys[0])), "n": len(keys), "total": int(counts.sum())}])

    counted = given.mapInArrow(words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    made = tk.cut(counted.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(write_words, "part bigint, path string, first string, n bigint, total bigint"), "words")
    rows = sorted(made.collect(), key=lambda r: r.part)  # one row per shard
    model = Model(folder, [(r.path, int(r.first), r.n) for r in rows], sum(r.total for r in rows))
    model.word_masses = [r.total for r in rows]
    for k in range(2, order + 1):
        _add_level(given, model, k, k < order)
    return model


class Walk:
    """Node numbers of the n-grams of many texts, level by level, with their probabilities."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, model.vocabulary()
        self.levels = [model.level(k) for k in range(2, len(model.levels) + 2)]

    def __call__(self, h: np.ndarray, first: np.ndarray):
        """Of token hashes and each document's first token: (word numbers, which tokens start a document, the node number of the highest level's n-gram that ends at each token or -1, counts, log10 probability)."""
        word, counts = self.vocabulary.find(h ^ _U(1 << 63), "counts")
        start = np.zeros(len(word), bool)
        start[first[:-1]] = True
        node, p = word, self.model.unigram(counts)
        for k, level in enumerate(self.levels, 2):
            context = self.context(node, start)
            at = np.flatnonzero((context >= 0) & (word >= 0))
            node = np.full(len(word), -1, np.int64)
            node[at], code = level.find(context[at].astype(np.uint64) * _U(self.model.size) + word[at].astype(np.uint64), "prob")
            missed = np.flatnonzero((node < 0) & (context >= 0))
            p[missed] += self.model.backoff(k, context[missed])
            p[at] = np.where(node[at] >= 0, _decoded(code), p[at])
        return word, start, node, counts, p

    def context(self, node: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.concatenate([[-1], node[:-1]])
        out[start] = -1
        return out


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """The tokens of texts until there are AT_ONCE: hashes, each document's first token, and the rows' first column in parts."""
    held, n = [], 0

    def out():
        base = np.cumsum([0] + [len(h) for h, _, _ in held])
        first = np.concatenate([*(f[:-1] + k for (_, f, _), k in zip(held, base[:-1], strict=True)), base[-1:]])
        return np.concatenate([h for h, _, _ in held]), first, [x for _, _, x in held]

    for batch in batches:
        for lo, hi, data, off in tk.chunks(batch.column(column), CHUNK):
            held.append((*tokens(data, off), batch.column(0).slice(lo, hi - lo)))
            n += len(held[-1][0])
            if n >= AT_ONCE:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def tokens_before(nodes: Sharded, masses: list[int], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens the nodes before each one have, and how many up to it (masses: of each shard)."""
    each, back = distinct(node)
    upto = nodes.values("mass", each, 0)
    which = np.searchsorted(nodes.base, each, "right") - 1
    before = np.where(each > nodes.base[which], nodes.values("mass", np.maximum(each - 1, 0), 0), 0)
    started = np.concatenate([[0], np.cumsum(masses)])[which]
    return (started + before)[back], (started + upto)[back]


def dealt(contexts: Sharded, masses: list[int], context: np.ndarray, share: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each n-gram by the tokens of the contexts before its own and, within its context, the share of tokens before its word."""
    before, upto = tokens_before(contexts, masses, context)
    return np.floor((before + (upto - before) * share) * (ranges / max(1, sum(masses)))).astype(np.int64)


def _add_level(given: DataFrame, model: Model, k: int, above: bool) -> None:
    """Counts and writes level k; ``above``: another level follows, which deals its runs by this one's counts."""
    spark, folder, size = given.sparkSession, model.folder, model.size
    ranges = max(1, -(-model.total // RANGE_TOKENS))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held, n = Walk(model), [], 0
        contexts, masses = (walk.vocabulary, model.word_masses) if k == 2 else (walk.levels[-1], model.masses[k - 3])

        def out():
            keys, counts, lower = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            context, word = (keys // _U(size)).astype(np.int64), (keys % _U(size)).astype(np.int64)
            # by expected mass, so that a frequent context is cut by its words
            at = dealt(contexts, masses, context, tokens_before(walk.vocabulary, model.word_masses, word)[0] / max(1, model.total), ranges)
            at = np.minimum(at, ranges - 1)
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            rows = [(int(at[a]), _delta(keys[a:b]), _zip(counts[a:b].astype(np.uint32)), _zip(lower[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["at", "keys", "counts", "lower"])

        for h, first, _ in gathered(batches, 0):
            word, start, node, _, p = walk(h, first)
            context = walk.context(node, start)
            at = np.flatnonzero(context >= 0)  # words of the training texts are all known
            if len(at):
                key = context[at].astype(np.uint64) * _U(size) + word[at].astype(np.uint64)
                held.append((key, np.ones(len(at), np.int64), p[at].astype(np.float16)))
                n += len(at)
                if n > HOLD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def write_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(at: int, parts):
            keys, counts, lower = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            context = (keys // _U(size)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            total, kinds = np.add.reduceat(counts, cuts), np.diff(np.append(cuts, len(keys)))
            lo, hi = int(context[0]), int(context[-1])
            each = np.repeat(np.arange(len(cuts)), kinds)
            # a context that is cut stands first or last; its totals come from all its shards, so its parts say what they have
            own = context[cuts]
            weight = DISCOUNT * kinds / total
            p = np.maximum(counts - DISCOUNT, 0) / total[each] + weight[each] * 10.0 ** lower.astype(np.float64)
            backoff = np.zeros(hi - lo + 1, np.uint8)
            backoff[own - lo] = _coded(np.log10(weight))
            mass = {"mass": np.cumsum(counts).astype(np.uint32 if counts.sum() < 1 << 32 else np.uint64)} if above else {}
            heads = slice(None) if len(cuts) == 1 else np.flatnonzero((each == 0) | (each == len(cuts) - 1))
            path = save(folder, f"level{k}-{at:07d}", level_arrays(context, (keys % _U(size)).astype(np.int64), size) | mass | {"prob": _coded(np.log10(p)), "backoff": backoff, "counts": counts[heads].astype(np.uint32), "lower": lower[heads]})  # for mend: those of the first and last context
            ends = [(int(own[i]), int(total[i]), int(kinds[i])) for i in sorted({0, len(own) - 1})]
            return {"at": at, "path": path, "first": str(int(keys[0])), "n": len(keys), "lo": lo, "hi": hi, "total": int(counts.sum()), "ends": str(ends)}

        current, parts, rows = None, [], []
        for batch in batches:
            for at, keys, counts, lower in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != current and parts:
                    rows.append(shard(current, parts))
                    parts = []
                current = at
                parts.append((_undelta(keys), _unzip(counts, np.uint32).astype(np.int64), _unzip(lower, np.float16)))
        if parts:
            rows.append(shard(current, parts))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("at", pa.int64()), ("path", pa.string()), ("first", pa.string()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("total", pa.int64()), ("ends", pa.string())]))

    sent = given.mapInArrow(runs, "at bigint, keys binary, counts binary, lower binary")
    made = tk.cut(sent.repartition("at").sortWithinPartitions("at").mapInArrow(write_level, "at bigint, path string, first string, n bigint, lo bigint, hi bigint, total bigint, ends string"), f"level{k}")
    rows = sorted(made.collect(), key=lambda r: r.at)  # one row per shard
    shards = [(r.path, int(r.first), r.n, r.lo, r.hi) for r in rows]
    import ast

    totals: dict[int, list[int]] = {}
    for r in rows:
        for c, total, kinds in ast.literal_eval(r.ends):
            t = totals.setdefault(c, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + total, t[1] + kinds, t[2] + 1
    split = {c: (t[0], t[1]) for c, t in totals.items() if t[2] > 1}
    if split:  # contexts that several shards share: their probabilities are made again with the whole totals

        def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    path, first, n, lo, hi = shards[i]
                    a, _ = load(folder, path)
                    prob = a["prob"].copy()
                    heads = []
                    for c in sorted({lo, hi}):
                        if c in split:
                            s, e = (int(x[0]) for x in successors(a, np.array([c])))
                            head = slice(e - s) if c == lo else slice(len(a["lower"]) - (e - s), None)
                            counts, lower = a["counts"][head].astype(np.float64), a["lower"][head]
                            total, kinds = split[c]
                            prob[s:e] = _coded(np.log10(np.maximum(counts - DISCOUNT, 0) / total + DISCOUNT * kinds / total * 10.0 ** lower.astype(np.float64)))
                            heads.append(c)
                    if heads:
                        path = save(folder, os.path.basename(path) + "m", {x: y for x, y in a.items() if x not in ("counts", "lower")} | {"prob": prob})
                    yield pa.RecordBatch.from_pylist([{"i": i, "path": path}])

        mended = tk.cut(spark.range(len(shards)).select("id").repartition(max(1, len(shards))).mapInArrow(mend, "i bigint, path string"), f"mended{k}")
        system, _ = filesystem(folder)
        for r in mended.collect():
            if r.path != shards[r.i][0]:
                system.delete_file(shards[r.i][0])  # the mended file has taken its place
            shards[r.i] = (r.path, *shards[r.i][1:])
    model.levels.append(shards)
    model.masses.append([r.total for r in rows])
    cut = np.array(sorted(split), np.int64)
    model.fixed.append((cut, np.array([np.log10(DISCOUNT * split[c][1] / split[c][0]) for c in cut.tolist()])))


# -- scoring ------------------------------------------------------------------------------------------------

SCORED = "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's tokens, known tokens, unigram score and trie score (log10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(model)
        for h, first, ids in gathered(batches, 1):
            _, _, _, counts, p = walk(h, first)
            out = (np.diff(first), np.add.reduceat((counts > 0).astype(np.int64), first[:-1]), np.add.reduceat(model.unigram(counts), first[:-1]), np.add.reduceat(p, first[:-1]))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(x) for x in out)], ["id", "n_tokens", "n_known", "base_score", "score"])

    tk.modest_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id's crc32 leaves 1 by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()), ORDER)
    return score(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
