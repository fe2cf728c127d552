"""Quality rules (7): a rule bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps what was
measured and one bit for each rule that failed; policies are versioned sets of
rules, so applying one, comparing two and computing ablations are bitwise
operations on the ledger and never read a text again.

Defined results: null text has no words (and so fails ``too_few_words``); an
empty table gives an empty ledger; repeated rows stay as they are; other
columns of the input, whatever their names, are not read by ``ledger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm import textkernel as tk

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_digits"]
SCHEMA = "row_id string, doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)

#: Rule name -> condition of failure, in SQL over the measures.  The position is the bit; new rules go to the end.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "shouting": "n_letters >= 50 and 100 * n_upper > 60 * n_letters",
    "exclamations": "4 * n_bangs > n_words",
    "long_words": "word_chars > 20 * n_words",
    "digits": "100 * n_digits > 50 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_words"],
    "v1": list(RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | (_BYTES >= 0x61) & (_BYTES <= 0x7A)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    word = tk.SPACE_WORD[data]
    starts, ends, first = tk.spans(word, off)
    n_docs = len(off) - 1
    # lines: between line feeds and document borders
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1])) if len(data) else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    doc = np.searchsorted(off, begin, "right") - 1
    with_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[with_word], stop[with_word], doc[with_word]
    stop = stop - ((stop > begin) & (data[np.maximum(stop, 1) - 1] == 10)) if len(stop) else stop
    key = tk.mix(tk.span_hash(data, begin, stop, False) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lines = np.bincount(doc, minlength=n_docs)
    once = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n_docs)
    # three-word windows that occur twice or more
    h, at = tk.windows(tk.span_hash(data, starts, ends, False), first, 3)
    word_doc = np.repeat(np.arange(n_docs), np.diff(first))
    key = tk.mix(h + word_doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    again = at[n[inverse] >= 2] if len(at) else at
    cover = np.zeros(len(starts) + 3, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeat = np.cumsum(cover)[: len(starts)] > 0
    return [
        np.diff(first), tk.counts(word & tk.NOT_CONT[data], off), tk.counts(_SYMBOL[data], off), lines - once, tk.counts(repeat, first), lines,
        tk.counts(_UPPER[data], off), tk.counts(_LETTER[data], off), tk.counts(data == 0x21, off), tk.counts(_DIGIT[data], off),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_measure(data, off) for _, _, data, off in tk.chunks(batch.column(2))]
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True))], ["row_id", "doc_id", *MEASURES])


def bits() -> Column:
    """One bit for each failed rule."""
    out = F.lit(0).cast("long")
    for name, condition in RULES.items():
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: Column | None = None) -> DataFrame:
    """Each row's measures and ``failed`` (bits of RULES); one pass over the texts, no shuffle."""
    tk.modest_batches(docs)
    given = docs.select((row_id if row_id is not None else F.lit(None)).cast("string").alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_measured, SCHEMA).withColumn("failed", bits())


def mask(policy: str | list[str]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def verdict(policy: str | list[str], failed: str | Column = "failed") -> Column:
    """Whether the policy keeps a row of the ledger."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str | list[str]) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and that the policy keeps without it.  One aggregation of the ledger, whatever the number of rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    within = F.col("failed").bitwiseAND(F.lit(mask(names)).cast("long"))
    each = [F.struct(F.lit(r).alias("rule"), F.count_if(within.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias("n_failed"), F.count_if(within == BIT[r]).alias("n_only"), F.count_if(within.bitwiseAND(F.lit(mask(names) & ~BIT[r]).cast("long")) == 0).alias("n_kept_without")) for r in names]
    return book.agg(F.array(*each).alias("rules")).select(F.inline("rules"))


def filter_documents(docs: DataFrame, policy: str | list[str] = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, columns unchanged.  Texts are measured where they lie: no join, no shuffle."""
    tk.modest_batches(docs)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # the input's names may clash with the measures'
    position = names.index(text_col)
    given = docs.toDF(*plain)
    schema = StructType([*given.schema.fields, *(StructField(m, LongType()) for m in MEASURES)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measure(data, off) for _, _, data, off in tk.chunks(batch.column(position))]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True))], [*plain, *MEASURES])

    return given.mapInArrow(measured, schema).where(verdict(policy, bits())).select(*plain).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ~verdict("base")
    return book.select("doc_id", *MEASURES[:5], base.alias("base_failed"), verdict("v1").alias("kept"), "failed")


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    row_number() over () as r
  from documents),
win as (
  select r, i, w[i:i+2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from t)),
rep as (
  select r, count(distinct p) as n from (
    select r, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by r, g) as c from win) where c >= 2)
  group by r),
m as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::bigint as n_letters,
    length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_bangs, length(regexp_replace(text, '[^0-9]', '', 'g'))::bigint as n_digits
  from t left join rep using (r)),
f as (select *, """ + " + ".join(f"case when {c} then {BIT[n]} else 0 end" for n, c in RULES.items()) + """ as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed, bits = 0 as kept, bits::bigint as failed from f
"""
