"""Token-ID / binary output (8): sorted-string-table shards.

Documents are ranged by identifier; each task writes the documents of its range,
in order, to shards in the shared folder.  A shard is

    header   "QSST1\\n"
    blocks   zstd of: counts, prefix-compressed keys, token counts, ids
    index    first key, offset, length, documents and tokens of each block
    bloom    a filter over the keys
    footer   places of index and filter, totals, checksum, "QSSTEND\\n"

so that one identifier is found by the manifest's first and last keys, the
filter, a binary search of the sparse index and one block.  Keys are 9 bytes that sort as the identifiers do (null
first); repeated identifiers are kept, in the order of their text hashes.

Defined results: null and empty texts have the end id alone; an empty table
gives no shards; other columns are not read.  A retried task writes the same
bytes to the same name (temporary name, then a move), so lost executors cost
only their own work.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

END_ID = 2
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 1 << 26
MAGIC, TAIL = b"QSST1\n", b"QSSTEND\n"
BLOOM_BITS, BLOOM_HASHES = 10, 7
CACHE_WORDS = 300_000
TEMPORARY = ".tmp"
_PLAIN, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: The byte-level alphabet of public tokenizers: printable Latin-1 stands for itself, the other bytes, in order, for U+0100 onwards.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_STOP[[ord(c) for c in ".,;:!?"]] = True
_CAPITAL = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)


def filesystem(uri: str):
    """(filesystem, path) of a URI, for files that no Spark writer makes."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# -- tokens -----------------------------------------------------------------------------------------------


class Encoder:
    """Token ids of whole texts by way of their distinct words.

    The tokenizer folds case and white space, and never joins what white space
    separates, so a text's ids are those of its words one after the other.  A
    space put between an ASCII letter or digit and the ASCII stop after it
    changes nothing either (the two are never one piece), but leaves fewer
    distinct words; so does folding A-Z.  The tokenizer composes letters with
    their marks before it folds, so a letter before a character beyond ASCII
    is left to it, and so is a chunk where a special token's brackets occur.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, new: list[bytes]):
        """Ids of new words.  A lower-case Latin word in composed form is one piece as it stands: the library's model alone encodes it."""
        model, found, others = self.tokenizer.model, [], []
        for i, w in enumerate(new):
            if w.isalpha() and w.islower():
                found.append([t.id for t in model.tokenize(w.decode())])
                continue
            text = w.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text):
                found.append([t.id for t in model.tokenize(w.decode("latin-1").translate(_BYTE_LEVEL))])
            else:
                others.append(i)
                found.append(text)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([found[i] for i in others], add_special_tokens=False), strict=True):
            found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each document) of a chunk."""
        stops = np.flatnonzero(_PLAIN[data[:-1]] & _STOP[data[1:]]) + 1
        off = off + np.searchsorted(stops, off)
        data = np.insert(data, stops, 32)
        if not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
            fold = _CAPITAL[data]
            fold[:-1] &= data[1:] < 0x80
            data[fold] += 32
        raw = data.tobytes()
        words: list[bytes] = []
        first = [0]
        for d in range(len(off) - 1):
            words += raw[off[d] : off[d + 1]].split()
            first.append(len(words))
        if len(self.number) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing]
            self.learn(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.array(first)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- keys, varints, filter --------------------------------------------------------------------------------


def key_of(identifier: int | None) -> bytes:
    return b"\0" * 9 if identifier is None else b"\1" + struct.pack(">Q", identifier + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int, out: bytearray):
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(k[1:] for k in keys), ">u8").astype(np.uint64) + np.array([k[0] for k in keys], np.uint64)
    a, b = tk.mix(raw), tk.mix(raw ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64)[None] * b[:, None]) % np.uint64(bits)


# -- writing ----------------------------------------------------------------------------------------------


class ShardWriter:
    """Writes one shard; keys must not descend."""

    def __init__(self, stream):
        self.out, self.at = stream, 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.seen: list[bytes] = []
        self.n_tokens = 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self._write(MAGIC)
        self._fresh()

    def _write(self, raw: bytes):
        self.out.write(raw)
        self.at += len(raw)

    def _fresh(self):
        self.keys, self.sizes, self.ids, self.held = bytearray(), bytearray(), [], 0
        self.first, self.last, self.count, self.tokens = None, b"", 0, 0

    def add(self, identifier: int | None, ids: np.ndarray):
        key = key_of(identifier)
        same = 0
        while same < len(self.last) and key[same] == self.last[same]:
            same += 1
        _varint(same, self.keys)
        self.keys += key[same:]
        _varint(len(ids), self.sizes)
        self.first, self.last = self.first or key, key
        self.seen.append(key)
        self.ids.append(ids)
        self.count += 1
        self.tokens += len(ids)
        self.held += 4 * len(ids)
        if self.held >= BLOCK_BYTES:
            self.flush()

    def flush(self):
        if not self.count:
            return
        ids = np.concatenate(self.ids)
        wide = len(ids) and int(ids.max()) > 0xFFFF
        body = struct.pack("<IIIB", self.count, len(self.keys), len(self.sizes), 4 if wide else 2) + self.keys + self.sizes + ids.astype("<u4" if wide else "<u2").tobytes()
        raw = self.zip.compress(bytes(body))
        self.index.append((self.first, self.at, len(raw), self.count, self.tokens))
        self._write(raw)
        self.n_tokens += self.tokens
        self._fresh()

    def close(self) -> dict:
        self.flush()
        at_index = self.at
        index = b"".join(k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        self._write(index)
        bits = max(64, BLOOM_BITS * len(self.seen))
        bloom = np.zeros(bits, bool)
        if self.seen:
            bloom[_bloom_places(self.seen, bits).ravel()] = True
        raw = np.packbits(bloom).tobytes()
        at_bloom = self.at
        self._write(raw)
        footer = struct.pack("<QQQQQQI", at_index, len(index), at_bloom, bits, len(self.seen), self.n_tokens, zlib.crc32(index + raw))
        self._write(footer + TAIL)
        return {"n_docs": len(self.seen), "n_tokens": self.n_tokens, "bytes": self.at, "first": self.seen[0] if self.seen else None, "last": self.seen[-1] if self.seen else None}


FOOTER = struct.calcsize("<QQQQQQI") + len(TAIL)


class Shard:
    """A shard opened for lookups and scans; only the footer, the index and the filter are held."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER)
        tail = source.read(FOOTER)
        if tail[-len(TAIL) :] != TAIL:
            raise ValueError("not a complete shard")
        at, n, at_bloom, self.bits, self.n_docs, self.n_tokens, crc = struct.unpack("<QQQQQQI", tail[: -len(TAIL)])
        source.seek(at)
        raw = source.read(n)
        source.seek(at_bloom)
        bloom = source.read(-(-self.bits // 8))
        if zlib.crc32(raw + bloom) != crc:
            raise ValueError("the index of a shard is damaged")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8))
        self.blocks = [(raw[i : i + 9], *struct.unpack("<QQQQ", raw[i + 9 : i + 41])) for i in range(0, n, 41)]
        self.firsts = [b[0] for b in self.blocks]

    def block(self, k: int) -> tuple[list[bytes], list[int], np.ndarray]:
        _, at, n, _, _ = self.blocks[k]
        self.source.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(n))
        count, n_keys, n_sizes, width = struct.unpack_from("<IIIB", raw)
        at, keys, key = 13, [], b""
        for _ in range(count):
            same, at = _read_varint(raw, at)
            key = key[:same] + raw[at : at + 9 - same]
            at += 9 - same
            keys.append(key)
        sizes = []
        for _ in range(count):
            n, at = _read_varint(raw, at)
            sizes.append(n)
        return keys, sizes, np.frombuffer(raw, "<u4" if width == 4 else "<u2", offset=13 + n_keys + n_sizes)

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            keys, sizes, ids = self.block(k)
            at = 0
            for key, n in zip(keys, sizes, strict=True):
                yield id_of(key), ids[at : at + n]
                at += n

    def lookup(self, identifier: int | None) -> list[np.ndarray]:
        """All documents of an identifier: filter, binary search of the index, then of the block."""
        key = key_of(identifier)
        if not self.blocks or not self.bloom[_bloom_places([key], self.bits).ravel().astype(np.int64)].all():
            return []
        out = []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            keys, sizes, ids = self.block(k)
            total = np.concatenate([[0], np.cumsum(sizes)])
            out += [ids[total[i] : total[i + 1]] for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key))]
        return out


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and their manifest (part, seq, path, n_docs, n_tokens, bytes, first and last key) below ``folder``; returns the manifest, one row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, base = filesystem(folder)
        encode = encoder(tokenizer).encode
        writer, rows, names = None, [], ()

        def close():
            nonlocal writer
            done = writer.close()
            writer.out.close()
            system.move(*names)
            rows.append({"part": part, "seq": len(rows), "path": names[1]} | done)
            writer = None

        try:
            for batch in batches:
                identifiers = batch.column(0).to_pylist()
                at = 0
                for _, _, data, off in tk.chunks(batch.column(1)):
                    ids, sizes = encode(data, off)
                    total = np.concatenate([[0], np.cumsum(sizes)])
                    for d in range(len(sizes)):
                        if writer is None:
                            system.create_dir(base, recursive=True)
                            names = (f"{base}/.{part:07d}-{len(rows):05d}.{attempt}{TEMPORARY}", f"{base}/{part:07d}-{len(rows):05d}.sst")
                            writer = ShardWriter(system.open_output_stream(names[0]))
                        writer.add(identifiers[at], np.append(ids[total[d] : total[d + 1]], np.uint32(end_id)))
                        at += 1
                        if writer.at + writer.held >= shard_bytes:
                            close()
            if writer is not None:
                close()
        except BaseException:
            if writer is not None:
                writer.out.close()
                system.delete_file(names[0])
            raise
        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
    tk.modest_batches(docs)
    # ties (repeated identifiers) are split too: by text, then by place
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), "tie", "place"]
    made = given.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(run, "part int, seq int, path string, n_docs bigint, n_tokens bigint, bytes bigint, first binary, last binary")
    spark = docs.sparkSession
    made.write.parquet(f"{folder}-manifest")
    _sweep(folder)
    return spark.read.schema(made.schema).parquet(f"{folder}-manifest")


def _sweep(folder: str) -> None:
    """Takes away what attempts that were killed have left."""
    from pyarrow import fs

    system, base = filesystem(folder)
    for found in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if found.path.endswith(TEMPORARY):
            system.delete_file(found.path)


def read(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the shards: one task a shard, one block at a time.

    The manifest, one row for each ``shard_bytes`` of output, comes to the driver for the running totals.
    """
    rows = sorted(manifest.collect(), key=lambda r: (r.part, r.seq))
    bases, total = [], 0
    for r in rows:
        bases.append((r.path, total))
        total += r.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with system.open_input_file(path) as source:
                    out: list[list] = [[], [], [], []]
                    for identifier, ids in Shard(source).scan():
                        for column, value in zip(out, (identifier, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "n_tokens", "ids_crc32"])
                            out = [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(bases, "path string, start bigint")
    return files.repartition(max(1, len(bases))).mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark, folder: str, manifest: DataFrame, identifier: int | None) -> list[np.ndarray]:
    """The token ids of one identifier's documents, from the shards whose keys reach around its own."""
    system, _ = filesystem(folder)
    key, out = key_of(identifier), []
    may = manifest.where((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key))).select("part", "seq", "path")
    for r in sorted(may.collect(), key=lambda r: (r.part, r.seq)):
        with system.open_input_file(r.path) as source:
            out += Shard(source).lookup(identifier)
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes the documents' shards to a new shared folder and reads them back."""
    spark = docs.sparkSession
    folder = tk.shared_folder(spark, "tokens")
    return read(spark, folder, write(docs, tokenizer or default_tokenizer(), folder, **options)).withColumnRenamed("id", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


