"""Settings: environment over TOML over defaults, validated."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

TRUE = {"1", "true", "yes", "on"}

#: Setting -> (environment variable, TOML section, default).
SOURCES: dict[str, tuple[str, str, object]] = {
    "books_dir": ("RAG_BOOKS_DIR", "paths", "books"),
    "index_dir": ("RAG_INDEX_DIR", "paths", "data/index"),
    "synthetic_output_dir": ("RAG_SYNTHETIC_OUTPUT_DIR", "paths", "data/synthetic"),
    "embedder_name": ("RAG_EMBEDDER", "models", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"),
    "reranker_name": ("RAG_RERANKER", "models", "cross-encoder/ms-marco-MiniLM-L-6-v2"),
    "chunk_size": ("RAG_CHUNK_SIZE", "params", 1200),
    "chunk_overlap": ("RAG_CHUNK_OVERLAP", "params", 180),
    "segmenter_mode": ("RAG_SEGMENTER_MODE", "models", "llm"),
    "segmenter_endpoint": ("RAG_SEGMENTER_ENDPOINT", "endpoints", None),
    "segmenter_model": ("RAG_SEGMENTER_MODEL", "models", "minimax-m2.5:cloud"),
    "segmenter_api_key": ("RAG_SEGMENTER_API_KEY", "auth", None),
    "ocr_endpoint": ("GLM_OCR_ENDPOINT", "endpoints", None),
    "ocr_model": ("GLM_OCR_MODEL", "models", "glm-ocr:q8_0"),
    "ocr_api_key": ("GLM_OCR_API_KEY", "auth", None),
    "answer_endpoint": ("RAG_ANSWER_ENDPOINT", "endpoints", None),
    "answer_model": ("RAG_ANSWER_MODEL", "models", "minimax-m2.5:cloud"),
    "answer_api_key": ("RAG_ANSWER_API_KEY", "auth", None),
    "context_chars": ("RAG_CONTEXT_CHARS", "params", 750),
    "bootstrap_on_startup": ("RAG_BOOTSTRAP_ON_STARTUP", "params", False),
    "checkpoint_path": ("RAG_SYNTHETIC_CHECKPOINT", "synthetic", "epoch_200.pt"),
    "device": ("RAG_SYNTHETIC_DEVICE", "synthetic", "cpu"),
    "stone_texture_dir": ("RAG_STONE_TEXTURE_DIR", "synthetic", None),
}


def _typed(value: object, default: object) -> object:
    if value is None:
        return default
    if isinstance(default, bool):
        text = str(value).strip().lower()
        return value if isinstance(value, bool) else text in TRUE if text else default
    if isinstance(default, int):
        try:
            return int(value)
        except (TypeError, ValueError):
            return default
    return str(value) or default


def dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; comments and lines without = are skipped, quotes taken off."""
    pairs = (line.strip().split("=", 1) for line in text.splitlines() if "=" in line and not line.strip().startswith("#"))
    return {k.strip(): v.strip().strip("'").strip('"') for k, v in pairs if k.strip()}


@dataclass(frozen=True)
class Settings:
    books_dir: str
    index_dir: str
    synthetic_output_dir: str
    embedder_name: str
    reranker_name: str
    chunk_size: int
    chunk_overlap: int
    segmenter_mode: str
    segmenter_endpoint: str | None
    segmenter_model: str
    segmenter_api_key: str | None
    ocr_endpoint: str | None
    ocr_model: str
    ocr_api_key: str | None
    answer_endpoint: str | None
    answer_model: str
    answer_api_key: str | None
    context_chars: int
    bootstrap_on_startup: bool
    checkpoint_path: str
    device: str
    stone_texture_dir: str | None

    @classmethod
    def load(cls, toml: str | Path | None = None, env_file: str | Path | None = None, env: dict[str, str] | None = None) -> Settings:
        """A variable that is set and not blank, else the TOML value, else the default; the file of variables overrides none that is set."""
        env = dict(os.environ if env is None else env)
        if env_file and Path(env_file).exists():
            env = dotenv(Path(env_file).read_text(encoding="utf-8")) | env
        tables = tomllib.loads(Path(toml).read_text(encoding="utf-8")) if toml and Path(toml).exists() else {}
        out = {}
        for name, (variable, section, default) in SOURCES.items():
            table = tables.get(section)
            value = table.get(name) if isinstance(table, dict) else None
            out[name] = _typed(env[variable] if env.get(variable, "").strip() else value, default)
        return cls(**{f.name: out[f.name] for f in fields(cls)})

    @property
    def images_dir(self) -> str:
        return f"{self.index_dir}/images"
