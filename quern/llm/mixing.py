"""Mixing sources to target weights (5): soft domain membership and document rates.

A classifier trained on the labelled table gives every document posteriors over
the domains.  Nonnegative document rates r are then fitted so that the expected
tokens of each domain, T_k = sum of r * tokens * p_k, meet the targets: least
squares of (T_k - target_k) / sqrt(S_k), S_k being T_k at rate 1, by projected
gradient steps with momentum.  In the metric of tokens a step is
r <- max(0, y - p . v) with v_k = (T_k - target_k) / S_k at the point y that
momentum leads to, whose Lipschitz constant is 1 (posteriors add up to one).  A
domain that falls short takes nothing from the others.  A step needs K sums over
all documents and nothing else: a document's rate is a function of its posteriors
and the short list of v, so no state is kept anywhere and a lost executor costs
one task.  Steps go on until every domain is within ``tolerance`` of its target,
or until ``PATIENCE`` steps take away less than ``GAIN`` of what is missing: the
targets can't be reached then, and the least squares stand.  A rate above one
asks for copies; ``most`` bounds the rates where copies are not wanted.

The fit uses a bounded sample of labelled rows (``SAMPLE``); posteriors,
moments, steps and decisions cover all documents.  The target total is that
which leaves the ``anchor`` domain's expected tokens as they are.

Defined results: null and empty texts have no tokens and the posteriors of an
empty text; without labelled rows posteriors are even; repeated rows are
documents of their own; of several labels of one id the worst domain counts, of
several texts that of the least hash; a domain without any posterior cannot be
reached and is left out; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

SAMPLE = 4000  # labelled rows for the fit, those of the smallest hashed ids
SELECTED = 1024  # words
CHI_SQUARED = 15.0  # what a word must tell at least
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
ANCHOR = "clean"
MOST = float("inf")
TOLERANCE = 1e-3  # of each domain's target
PATIENCE, GAIN = 5, 0.05
ROUNDS, RATE, L2 = 150, 0.1, 1e-4

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BARE = np.ones(256, bool)  # what counts in a word
_BARE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = False
_BARE &= ~tk.WHITE
N_SHAPE = 7


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each word's document and each document's number of words."""
    starts, ends, first = tk.spans(_BARE[data], off)
    return tk.span_hash(data, starts, ends, True), np.repeat(np.arange(len(off) - 1), np.diff(first)), np.diff(first)


def _shape(data: np.ndarray, off: np.ndarray, hashes: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ratios that need no vocabulary: (documents, N_SHAPE)."""
    size = np.maximum(np.diff(off), 1)
    key = tk.mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=len(n)) if len(key) else np.zeros(len(n))
    words = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), tk.counts(_UPPER[data], off) / size, tk.counts(data == 0x21, off) / words, tk.counts(_SYMBOL[data], off) / words, distinct / words, np.minimum(np.log1p(n) / 10, 1), np.minimum(size / words / 10, 3)], 1)


@dataclass
class Classifier:
    domains: tuple[str, ...]
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = None  # (N_SHAPE + words, domains)

    def __post_init__(self):
        if self.weight is None:
            self.weight = np.zeros((N_SHAPE + len(self.words), len(self.domains)))

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each document of a chunk."""
        hashes, doc, n = _words(data, off)
        logits = _shape(data, off, hashes, doc, n) @ self.weight[:N_SHAPE]
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            pair = np.unique(doc[hit] * len(self.words) + at[hit])
            np.add.at(logits, pair // len(self.words), self.weight[N_SHAPE + pair % len(self.words)])
        p = np.exp(logits - logits.max(1, keepdims=True))
        return n, p / p.sum(1, keepdims=True)


def domain_of() -> Column:
    """The labelled table's domain, as a position in DOMAINS."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, domains: tuple[str, ...] = DOMAINS) -> Classifier:
    """Multinomial logistic regression on word presence and shape, from at most ``sample`` labelled rows."""
    tk.modest_batches(docs)
    worst = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(domain_of() if domain is None else domain).alias("domain"))
    chosen = worst.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    given = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).groupBy("__id", "domain").agg(F.min_by(docs[text_col], F.struct(F.xxhash64(docs[text_col]), docs[text_col])).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape, seen = [], []
            for _, _, data, off in tk.chunks(batch.column(2)):
                hashes, doc, n = _words(data, off)
                shape += _shape(data, off, hashes, doc, n).tolist()
                seen += [np.unique(hashes[doc == d]).view(np.int64).tolist() for d in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(shape, pa.list_(pa.float64())), pa.array(seen, pa.list_(pa.int64()))], ["id", "domain", "shape", "words"])

    # words go to the driver for the sample alone; those of one document only are dropped before
    rows = given.mapInArrow(read, "id bigint, domain int, shape array<double>, words array<bigint>").toArrow().sort_by("id")
    model = Classifier(domains)
    if not rows.num_rows:
        return model
    k = len(domains)
    y = rows.column("domain").to_numpy()
    words = rows.column("words").combine_chunks()
    row = np.repeat(np.arange(len(y)), np.diff(words.offsets.to_numpy()))
    hashes, column, df = np.unique(words.flatten().to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    # the words that tell the domains apart best, by chi-squared of presence
    share = np.bincount(y, minlength=k) / len(y)
    each = np.stack([np.bincount(column[y[row] == d], minlength=len(hashes)) for d in range(k)], 1)
    expected = df[:, None] * share[None]
    score = np.where(df >= 3, ((each - expected) ** 2 / np.maximum(expected, 1e-9)).sum(1), 0)
    best = np.sort(np.argsort(-score, kind="stable")[: min(SELECTED, int((score > CHI_SQUARED).sum()))])
    place = np.full(len(hashes), -1)
    place[best] = np.arange(len(best))
    kept = place[column] >= 0
    row, column = row[kept], place[column[kept]]
    shape = np.array(rows.column("shape").to_pylist())
    weight, m, v = (np.zeros((N_SHAPE + len(best), k)) for _ in range(3))
    target = np.eye(k)[y]
    for step in range(1, ROUNDS + 1):
        logits = shape @ weight[:N_SHAPE]
        for d in range(k):
            logits[:, d] += np.bincount(row, weight[N_SHAPE + column, d], len(y))
        p = np.exp(logits - logits.max(1, keepdims=True))
        wrong = (p / p.sum(1, keepdims=True) - target) / len(y)
        grad = L2 * weight
        grad[:N_SHAPE] += shape.T @ wrong
        for d in range(k):
            grad[N_SHAPE:, d] += np.bincount(column, wrong[row, d], len(best))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(domains, hashes[best], weight)


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p): one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model(data, off) for _, _, data, off in tk.chunks(batch.column(1))]
            if parts:
                n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _lists(p)], ["id", "n_tokens", "p"])

    tk.modest_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n_tokens bigint, p array<double>")


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rates(p: np.ndarray, steps: list[np.ndarray], most: float = MOST) -> np.ndarray:
    """Each document's rate after the given steps: from 1 (or the bound below it), clipped after each."""
    r = y = np.full(len(p), min(1.0, most))
    for i, v in enumerate(steps):
        new = np.clip(y - p @ v, 0, most)
        y, r = new + _momentum(i) * (new - r), new
    return r


def _momentum(step: int) -> float:
    return step / (step + 3)


@dataclass
class Fit:
    """The steps of the projected gradient and, by domain, tokens at rate one, target and reached tokens."""

    domains: tuple[str, ...]
    steps: list[np.ndarray]
    natural: np.ndarray
    target: np.ndarray
    reached: np.ndarray


def solve(table: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, most: float = MOST, domains: tuple[str, ...] = DOMAINS, tolerance: float = TOLERANCE) -> Fit:
    """Fits the rates, each step from one small aggregation over the table (n_tokens, p)."""
    k = len(domains)
    weights = np.array([targets.get(d, 0.0) for d in domains])
    weights = weights / weights.sum()

    def summed(steps: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                p = _matrix(batch.column(1))
                total += p.T @ (batch.column(0).to_numpy() * rates(p, steps, most))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(k)])

        parts = table.select("n_tokens", "p").mapInArrow(run, ", ".join(f"s{i} double" for i in range(k)))
        return np.array([x or 0.0 for x in parts.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).first()])

    natural = summed([])
    goal = weights * natural[domains.index(anchor)] / weights[domains.index(anchor)]
    fit = Fit(domains, [], natural, goal, natural)
    scale = np.divide(1.0, natural, out=np.zeros(k), where=natural > 0)
    miss = lambda t: float(((t - goal) ** 2 * scale).sum())
    misses, best, before, ahead, steps = [miss(natural)], fit, natural, natural, []
    while natural.sum() and (np.abs(best.reached - goal) > tolerance * np.maximum(goal, tolerance * natural.sum())).any():
        if len(misses) > PATIENCE and min(misses) >= (1 - GAIN) * min(misses[:-PATIENCE]):
            break
        steps = [*steps, (ahead - goal) * scale]
        now = summed(steps)
        ahead, before = now + _momentum(len(steps) - 1) * (now - before), now  # the sums are linear in the rates
        misses.append(miss(now))
        if misses[-1] <= min(misses):
            best = Fit(domains, steps, natural, goal, now)
    return best


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, most: float = MOST, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p, rate) of every document, and by domain the target and the reached tokens (target_x, reached_x, the same in every row)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    table = tk.cut(posteriors(docs, model, id_col, text_col), "posteriors")
    found = solve(table, targets, anchor, most, tolerance=tolerance)
    steps = found.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(_matrix(batch.column(2)), steps, most))], ["id", "n_tokens", "p", "rate"])

    totals = [F.lit(float(x)).alias(f"{name}_{d}") for name, xs in (("target", found.target), ("reached", found.reached)) for d, x in zip(found.domains, xs, strict=True)]
    return table.mapInArrow(run, "id bigint, n_tokens bigint, p array<double>, rate double").select("id", "n_tokens", "p", "rate", *totals)


def chance(id_col: str, text_col: str) -> Column:
    """A number in [0, 1) that depends on the row alone."""
    return F.pmod(F.xxhash64(F.lit("mix"), id_col, text_col), F.lit(1 << 40)) / float(1 << 40)


def apply_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, most: float = MOST, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents by their rates, columns unchanged: floor(rate) copies and one more by chance of the rest.  A rate follows from the text, so nothing is joined."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    steps = solve(tk.cut(posteriors(docs, model, id_col, text_col), "posteriors"), targets, anchor, most, tolerance=tolerance).steps
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    position = names.index(text_col)
    given = docs.toDF(*plain).withColumn("chance", chance(f"c{names.index(id_col)}", f"c{position}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model(data, off)[1] for _, _, data, off in tk.chunks(batch.column(position))]
            if parts:
                r = rates(np.concatenate(parts), steps, most)
                copies = np.floor(r).astype(np.int64) + (batch.column(len(names)).to_numpy() < r % 1)
                yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies))).drop_columns(["chance"])

    return given.mapInArrow(run, given.drop("chance").schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", *(F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), F.round("rate", 9).alias("rate"), *(F.round(f"{name}_{d}", 3).alias(f"{name}_{d}") for d in DOMAINS for name in ("target", "reached")))
