"""Secret scans (10): a trigram inverted index in front of the rules' regexes.

Each rule's regex is parsed and turned into a Boolean query over trigrams that
every match must hold.  Texts are indexed shard by shard (a shard is a bounded
run of whole documents): the postings of the trigrams that some rule asks for.
A rule's query intersects and unites postings; the documents that remain are
verified with the regex itself over their whole text.  A rule whose query is
empty (no mandatory trigram, as runs of hex digits) scans every document.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; an empty table gives an empty result; other columns are not read.
Offsets are code points, ends exclusive.  Case is that of ASCII only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sc  # type: ignore[attr-defined]
from re import _parser as sp  # type: ignore[attr-defined]

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

# -- Boolean trigram queries ------------------------------------------------------------------------------
# True (any document), a trigram (bytes, lower case), or ("and" | "or", frozenset of queries)

MOST_STRINGS = 64


def both(kind: str, parts) -> object:
    parts = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == kind else [p])}
    if kind == "and":
        parts.discard(True)
        if not parts:
            return True
    elif True in parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def _of_strings(strings: set[bytes]) -> object:
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in strings])


def _bytes_of(item) -> set[bytes] | None:
    """The folded single bytes that a class stands for, if they are few."""
    out: set[bytes] = set()
    for op, arg in item:
        if op is sc.LITERAL:
            out.add(bytes([arg]).lower())
        elif op is sc.RANGE and arg[1] - arg[0] < 4:
            out |= {bytes([b]).lower() for b in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _walk(parsed) -> tuple[set[bytes] | None, object]:
    """The exact folded strings that a pattern matches if they are few, else None, and the query that its matches fulfil."""
    exact: set[bytes] = {b""}  # of the run of exact items so far
    whole, query = True, []

    def stop():
        nonlocal exact, whole
        query.append(_of_strings(exact))
        exact, whole = {b""}, False

    for op, arg in parsed:
        strings, inner = None, True
        if op is sc.LITERAL:
            strings = {bytes([arg]).lower()}
        elif op is sc.IN:
            strings = _bytes_of(arg)
        elif op is sc.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sc.BRANCH:
            found = [_walk(x) for x in arg[1]]
            strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
            inner = both("or", [q for _, q in found])
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
            least, most, what = arg
            strings, inner = _walk(what)
            if strings is not None and (least, most) == (0, 1):
                strings, inner = strings | {b""}, True
            elif strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
                every = {b""}
                for _ in range(least):
                    every = {a + b for a in every for b in strings}
                strings, inner = every, _of_strings(every)
            else:
                if strings is not None and least:  # at least so many in a row
                    query.append(_of_strings({a + b for a in exact for b in strings}) if len(exact) * len(strings) <= MOST_STRINGS else True)
                strings, inner = None, inner if least else True
        elif op in (sc.AT, sc.ASSERT, sc.ASSERT_NOT):
            continue
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
        elif strings is not None:
            stop()
            exact = strings
        else:
            query.append(inner)
            stop()
    if whole:
        return exact, _of_strings(exact)
    query.append(_of_strings(exact))
    return None, both("and", query)


def trigram_query(pattern: bytes) -> object:
    """What every text with a match must hold, as a Boolean query over lower-cased trigrams; True if nothing is mandatory."""
    return _walk(sp.parse(pattern))[1]


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


# -- rules ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    least: int = 0  # bytes that the group must have
    group: int = 0
    flags: int = 0


#: The base rules first, in their order; then the method's own.  All take time linear in a text: a run that many starts could share begins at a border.
RULES: list[Rule] = [
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.IGNORECASE),
    Rule("access", rb"AKIA[A-Z0-9]+", 20),
    Rule("hex", rb"[0-9a-f]+", 24),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", rb"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", rb"://[A-Za-z0-9_.-]+:[^\x20\x09-\x0D/@:]+@[A-Za-z0-9-]"),
]
BASE = ("assign", "access", "hex")
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _found(rule: Rule, compiled, text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Shard:
    """The trigram postings of some whole documents, for the trigrams that queries ask for."""

    def __init__(self, data: np.ndarray, off: np.ndarray, wanted: dict[bytes, int], table: np.ndarray):
        self.n = len(off) - 1
        low = tk.LOWER[data].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        number = table[code]
        at = np.flatnonzero(number)
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + 3 <= off[doc + 1]
        pairs = np.unique(number[at][inside].astype(np.int64) * self.n + doc[inside])
        self.wanted, self.trigram, self.doc = wanted, pairs // self.n, pairs % self.n

    def posting(self, trigram: bytes) -> np.ndarray:
        k = self.wanted[trigram]
        lo, hi = np.searchsorted(self.trigram, [k, k + 1])
        return self.doc[lo:hi]

    def search(self, query: object) -> np.ndarray:
        """The documents that fulfil a query, by intersecting and uniting postings."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.posting(query)
        if query[0] == "or":
            return np.unique(np.concatenate([self.search(q) for q in query[1]]))
        out = None
        for q in sorted(query[1], key=lambda q: isinstance(q, tuple)):  # single trigrams first: they shrink the rest
            found = self.search(q)
            out = found if out is None else np.intersect1d(out, found, assume_unique=True)
            if not len(out):
                break
        return out


def scanner(rules: list[Rule] = RULES) -> Callable[[pa.Array], list[list[tuple[int, int, int]]]]:
    """A function from a text column to each row's spans (start, number of the rule, end), in bytes turned to code points."""
    queries = [trigram_query(r.pattern) for r in rules]
    compiled = [re.compile(r.pattern, r.flags) for r in rules]
    wanted = {t: i + 1 for i, t in enumerate(sorted(set().union(*(trigrams_of(q) for q in queries))))}
    table = np.zeros(1 << 24, np.uint16)
    for t, i in wanted.items():
        table[(t[0] << 16) | (t[1] << 8) | t[2]] = i

    def scan(column: pa.Array) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = []
        for _, _, data, off in tk.chunks(column):
            rows: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
            shard = Shard(data, off, wanted, table)
            for k, rule in enumerate(rules):
                if queries[k] is True and rule.pattern == rb"[0-9a-f]+":  # scans fully: the runs of the class, all documents at once
                    starts, ends, _ = tk.spans(_HEX[data], off)
                    far = ends - starts >= rule.least
                    for s, e in zip(starts[far], ends[far], strict=True):
                        d = int(np.searchsorted(off, s, "right")) - 1
                        rows[d].append((int(s - off[d]), k, int(e - off[d])))
                    continue
                for d in shard.search(queries[k]):
                    text = data[off[d] : off[d + 1]].tobytes()
                    rows[d] += [(s, k, e) for s, e in _found(rule, compiled[k], text)]
            for d, spans in enumerate(rows):
                if spans:
                    point = np.concatenate([[0], np.cumsum(tk.NOT_CONT[data[off[d] : off[d + 1]]])])
                    rows[d] = sorted((int(point[s]), k, int(point[e])) for s, k, e in spans)
            out += rows
        return out

    return scan


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Each row's secrets: (id, array of kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in batches:
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in r] for r in find(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["id", "spans"])

    tk.modest_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    kinds = [r.kind for r in RULES]
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in BASE]
    place = F.array(*map(F.lit, kinds))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x.start.alias("s"), F.array_position(place, x.kind).alias("k"), x.end.alias("e"), x.kind.alias("kind"))))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")
    return found.select(F.col("id").alias("doc_id"), *n, ordered.alias("o")).select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(text(F.filter("o", lambda x: x.k <= len(BASE))), 256).alias("base_sha256"), text(F.col("o")).alias("spans"))


def brute(text: str | None, rules: list[Rule] = RULES) -> list[tuple[str, int, int]]:
    """The plain way, for tests: every regex over every text."""
    raw = (text or "").encode()
    out = []
    for k, r in enumerate(rules):
        for s, e in _found(r, re.compile(r.pattern, r.flags), raw):
            out.append((len(raw[:s].decode()), k, len(raw[:e].decode())))
    return [(rules[k].kind, s, e) for s, k, e in sorted(out)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
