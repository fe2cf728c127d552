"""The service behind the routes: ingest, query, health, synthetic data; errors are ValueError (bad request) or RuntimeError (not ready)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import responses
from quern.functions import vectors as V
from quern.operators import datasets, rank, store
from quern.operators.bookindex import BookIndex
from quern.plans.tables import written
from quern.sources import endpoints

EMBEDDERS = {"blake2b": V.hash_embedding}
RERANKERS = {"none": None, "off": None, "passthrough": None}


def between(name: str, value, least, most):
    if value is None or not least <= value <= most:
        raise ValueError(f"{name} must be {least}..{most}")
    return value


def embedder(name: str):
    """A registered embedder (text column -> ARRAY<FLOAT>); models are added to EMBEDDERS."""
    if not (name or "").strip() or name == "hash":
        raise ValueError("an embedder has to be named")
    if name.startswith("ollama:"):
        model = name.split(":", 1)[1].removeprefix("//").strip()
        if not model:
            raise ValueError("the embedder's model has to be named")
        return endpoints.embedder(endpoints.Endpoint(os.environ.get("RAG_OLLAMA_ENDPOINT", "http://127.0.0.1:11434"), model, timeout=240))
    if name not in EMBEDDERS:
        raise RuntimeError(f"embedder {name!r} is not registered")
    return EMBEDDERS[name]


def segmenter(settings: Settings):
    """What cuts sections into chunks: a model (``llm``: rows -> rows, asked twice, then a mending call) or the rules (``rules``: None)."""
    mode = (settings.segmenter_mode or "").strip().lower()
    if mode == "rules":
        return None
    if mode not in SEGMENTERS:
        raise ValueError(f"segmenter mode {settings.segmenter_mode!r} is not known")
    if not settings.segmenter_endpoint or not settings.segmenter_model:
        raise ValueError("the segmenter needs an endpoint and a model")
    return SEGMENTERS[mode](settings)


def _by_model(settings: Settings):
    ask = endpoints.chat(endpoints.Endpoint(settings.segmenter_endpoint, settings.segmenter_model, settings.segmenter_api_key, timeout=180))
    return lambda rows: responses.chunk_rows(rows, [ask, ask, ask], settings.chunk_size, settings.chunk_overlap)


SEGMENTERS = {"llm": _by_model}


def answerer(settings: Settings):
    """(query, context) columns -> answer text, or None where no endpoint is set."""
    if not settings.answer_endpoint:
        return None
    ask = endpoints.chat(endpoints.Endpoint(settings.answer_endpoint, settings.answer_model, settings.answer_api_key, timeout=90))
    prompt = lambda query, context: F.concat(F.lit("Answer the question from the passages alone; name their pages.\nQuestion: "), query, F.lit("\n\n"), F.coalesce(context, F.lit("")))
    return lambda query, context: responses.message(ask(prompt(query, context)))


def reranker(name: str):
    if not (name or "").strip():
        raise ValueError("a reranker has to be named")
    if name.lower() not in RERANKERS and name not in RERANKERS:
        raise RuntimeError(f"reranker {name!r} is not registered")
    return RERANKERS.get(name, RERANKERS.get(name.lower()))


class Retrieval:
    """Ingest and search over the index stored below ``root``; a query sees what the last batch has left.

    Sections are cut by the settings' segmenter where an endpoint is set, else by the rules.
    """

    def __init__(self, spark: SparkSession, settings: Settings, root: str, embed: str = "blake2b"):
        self.spark, self.settings, self.root, self.name, self.embed = spark, settings, root, embed, embedder(embed)

    def index(self) -> BookIndex:
        segment = segmenter(self.settings) if self.settings.segmenter_endpoint else None
        return BookIndex(self.spark, self.root, self.embed, size=self.settings.chunk_size, overlap=self.settings.chunk_overlap, segment_rows=segment)

    def _ready(self) -> BookIndex:
        index = self.index()
        if not index.exists:
            raise RuntimeError("no index has been built")
        if (built := store.meta(self.spark, self.root).get("embedder", self.name)) != self.name:
            raise RuntimeError(f"the index was built with the embedder {built!r}")
        return index

    def ingest(self, books: DataFrame, pages: DataFrame, images: DataFrame | None = None) -> dict:
        """Replaces the given books; the others stay as they are, and so do their files."""
        index = self._ready() if store.current(self.spark, self.root) else self.index()
        return {"status": "ok"} | index.upsert(books, pages, images, about={"embedder": self.name})

    def rebuild(self, books: DataFrame, pages: DataFrame, images: DataFrame | None = None) -> dict:
        """The index of these books alone: they are brought in, then all others are taken out."""
        out = self.ingest(books, pages, images)
        index = self.index()
        others = index.tables.read("books").select("book_id").join(books.select("book_id"), "book_id", "left_anti")
        if not others.isEmpty():
            index.remove(others)
        return out | {"total_nodes": index.tables.totals["nodes"], "indexable_nodes": index.tables.totals["indexable"]}

    def remove(self, books: DataFrame) -> dict:
        index = self._ready()
        index.remove(books)
        return {"status": "ok", "total_nodes": index.tables.totals["nodes"], "indexable_nodes": index.tables.totals["indexable"]}

    def query(self, queries: DataFrame, top_k: int = 8, branch_factor: int = 4, rerank_by: str = "none", model=None) -> DataFrame:
        """(query_id, answer, reading_pages) of (query_id, query)."""
        between("top_k", top_k, 1, 40)
        between("branch_factor", branch_factor, 1, 20)
        if not queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").isEmpty():
            raise ValueError("a question is empty")
        scorer = reranker(rerank_by)
        hits = rank.retrieve(self._ready(), queries, top_k, branch_factor)
        if scorer:
            hits = rank.rerank(hits.join(queries, "query_id"), scorer(F.col("query"), F.concat_ws("\n", "path", "text"))).drop("query")
        return rank.answers(written(hits, "hits"), queries, model or answerer(self.settings))

    def health(self) -> dict:
        ready = store.is_complete(self.spark, self.root, ("nodes",))
        meta = store.meta(self.spark, self.root) if ready else {}
        return {"status": "ok" if ready else "not ready", "index_ready": ready, "total_nodes": meta.get("num_nodes", 0), "indexable_nodes": meta.get("num_indexable", 0)}


class Synthesis:
    def __init__(self, spark: SparkSession, classes: list[str]):
        self.spark, self.classes = spark, classes

    def dataset(self, make, variants: int = 10, base_seed: int = 42) -> DataFrame:
        between("variants_per_class", variants, 1, 500)
        return datasets.render_samples(datasets.plan_samples(self.spark, self.classes, variants, base_seed), make)

    def detection_dataset(self, backgrounds: DataFrame, background, repeats: int = 1, least: int = 3, most: int = 8, base_seed: int = 42) -> DataFrame:
        between("images_per_background", repeats, 1, 500)
        return datasets.render_scenes(datasets.plan_scenes(backgrounds, repeats, least, most, base_seed), self.classes, background)

    def health(self) -> dict:
        return {"status": "ok" if self.classes else "not ready", "classes": len(self.classes)}
