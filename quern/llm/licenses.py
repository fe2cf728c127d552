"""License scans (3): fuzzy search for short notices.

A notice is split into (errors + 1) pieces; by the pigeonhole principle a text
that holds the notice with at most that many edits holds one piece unchanged.
One automaton finds the pieces exactly, each hit names a window, and the regex
library's bounded-error matching verifies the window and gives the span.

Texts are compared as words (A-Z folded, digits, letters and everything beyond
ASCII) joined by single spaces, so line breaks and punctuation never count as
edits.  The base rule (a phrase's words standing consecutively) is exact.

Defined results: null and empty texts have no words and no labels; repeated
rows are scanned each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

#: Fixed by the contract: phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices by label, as words.
NOTICES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("proprietary", "all rights reserved"),
]
#: One edit for so many characters of the notice, between 1 and MOST_ERRORS.
CHARS_PER_ERROR = 10
MOST_ERRORS = 4


def errors_of(notice: str) -> int:
    return max(1, min(MOST_ERRORS, len(notice) // CHARS_PER_ERROR))


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 parts that make up the notice."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def searcher(notices: list[tuple[str, str]] = NOTICES) -> Callable[[str], list[tuple[str, int, int, float]]]:
    """A function from normalised text to (label, start, end, similarity) of the notices in it, best match for each place."""
    automaton = ahocorasick.Automaton()
    seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
    patterns = []
    for i, (_, notice) in enumerate(notices):
        e = errors_of(notice)
        patterns.append(regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={e}}}(?![^ ])", regex.V1))
        for at, piece in pieces(notice, e):
            seeds[piece].append((i, at))
    for piece, of in seeds.items():
        automaton.add_word(piece, (len(piece), of))
    automaton.make_automaton()

    def search(text: str) -> list[tuple[str, int, int, float]]:
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, of) in automaton.iter(text):
            begin = last + 1 - size
            for i, at in of:
                notice = notices[i][1]
                e = errors_of(notice)
                lo, hi = max(0, begin - at - e), min(len(text), begin - at + len(notice) + e)
                # whole words at both ends; no match that holds the seed reaches further than a notice's length into one
                far = len(notice) + 2 * e
                if lo and text[lo - 1] != " ":
                    lo = text.rfind(" ", max(0, lo - far), lo) + 1 or max(0, lo - far)
                if hi < len(text) and text[hi] != " ":
                    cut = text.find(" ", hi, hi + far)
                    hi = cut if cut >= 0 else min(len(text), hi + far)
                # seeds of one place share a window; places further apart keep their own, so none hides another
                if windows[i] and lo <= windows[i][-1][1] and hi - windows[i][-1][0] <= 2 * len(notice):
                    windows[i][-1][0], windows[i][-1][1] = min(lo, windows[i][-1][0]), max(hi, windows[i][-1][1])
                else:
                    windows[i].append([lo, hi])
        out = {}
        for i, places in windows.items():
            label, notice = notices[i]
            while places:
                lo, hi = places.pop()
                if hi > lo and (m := patterns[i].search(text, lo, hi)) and m.end() > m.start():  # the best of the window; what lies beside it may hold others
                    out[label, m.start(), m.end()] = max(out.get((label, m.start(), m.end()), 0), 1 - sum(m.fuzzy_counts) / len(notice))
                    places += [[lo, m.start()], [m.end(), hi]]
        return sorted(fitting((label, s, e, x) for (label, s, e), x in out.items()))

    return search


def fitting(found: Iterable[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Where notices overlap, those that fit best (all that fit alike): each similarity, from the best down, keeps what lies beside the places that better ones hold."""
    best: list[tuple[str, int, int, float]] = []
    starts: list[int] = []  # the places held so far, apart from each other and in order
    ends: list[int] = []
    for _, alike in groupby(sorted(found, key=lambda y: -y[3]), key=lambda y: y[3]):
        kept = []
        for y in alike:
            k = bisect_left(starts, y[2]) - 1  # the last place that starts before this one ends
            if k < 0 or ends[k] <= y[1]:
                kept.append(y)
        best += kept
        places = sorted([*zip(starts, ends, strict=True), *((y[1], y[2]) for y in kept)])
        starts, ends = [], []
        for s, e in places:
            if ends and s < ends[-1]:
                ends[-1] = max(e, ends[-1])
            else:
                starts.append(s)
                ends.append(e)
    return best


_PHRASES = [(phrase.encode().split(), label) for phrase, label in BASE.items()]
SCHEMA = "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<label:string,first_word:bigint,last_word:bigint,similarity:double>>"


def _word_key(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return tk.span_hash(data, np.array([0]), np.array([len(data)]), True)[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Each row's base places, labels and notices (spans in words, last word included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(notices)
        keys = [([_word_key(w) for w in words], words, label) for words, label in _PHRASES]
        for batch in batches:
            rows = []
            for _, _, data, off in tk.chunks(batch.column(1)):
                starts, ends, first = tk.spans(tk.ALNUM_WORD[data], off)
                hashes = tk.span_hash(data, starts, ends, True)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
                base: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for key, words, label in keys:
                    m = len(hashes) - len(key) + 1
                    if m <= 0:
                        continue
                    hit = doc[:m] == doc[len(key) - 1 :]
                    for j, k in enumerate(key):
                        hit &= hashes[j : j + m] == k
                    for w in np.flatnonzero(hit):
                        if all(data[starts[w + j] : ends[w + j]].tobytes().lower() == words[j] for j in range(len(words))):
                            base[int(doc[w])].append((int(w - first[doc[w]]), label))
                for d in range(len(off) - 1):
                    text = b" ".join(tk.normalised(data[off[d] : off[d + 1]].tobytes(), tk.ALNUM_TABLE)).decode()
                    found = search(text)
                    if found:
                        spaces = np.flatnonzero(np.array([*map(ord, text)], np.uint32) == 32) if not text.isascii() else np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
                        found = [(label, *map(int, np.searchsorted(spaces, (s, e))), x) for label, s, e, x in found]
                    own = base.get(d, [])
                    at = [w for w, _ in own]
                    rows.append({
                        "n_words": int(first[d + 1] - first[d]), "n_base": len(own), "first_word": min(at, default=None), "last_word": max(at, default=None),
                        "base_labels": ",".join(sorted({x for _, x in own})), "labels": ",".join(sorted({x for _, x in own} | {x[0] for x in found})),
                        "score": 1.0 if own else max((x[3] for x in found), default=0.0),
                        "notices": [dict(zip(("label", "first_word", "last_word", "similarity"), x, strict=True)) for x in found],
                    })
            if rows:
                types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "notices": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("similarity", pa.float64())]))}
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in types.items())], ["id", *types])

    tk.modest_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x.label, x.first_word, x.last_word)), ",")
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", spans.alias("notices"))


def brute(text: str | None) -> tuple:
    """The base rule the plain way, for tests."""
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))
