"""Models behind HTTP: embeddings, chat and vision answers for columns, asked in batches from the executors.

A Python worker keeps its own connections, asks with a few threads and keeps
the pace that an endpoint allows, which all threads share.  A call has a hard
end: retries, pauses and slow answers together take no longer.  Servers that
say when to come back are asked again then.
"""

from __future__ import annotations

import base64
import datetime
import email.utils
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

BATCH = 64  # texts of one embedding call
AGAIN = {408, 425, 429, 500, 502, 503, 504}


@dataclass(frozen=True)
class Endpoint:
    """url: where calls go; timeout: seconds that a call may take with all its tries; pace: least seconds between the calls of a worker."""

    url: str
    model: str
    key: str | None = None
    timeout: float = 90.0
    tries: int = 3
    delay: float = 1.0
    pace: float = 0.0
    threads: int = 4


class _Pace:
    """When an endpoint may be called next, for all threads of a process."""

    lock = threading.Lock()
    free: dict[str, float] = {}

    @classmethod
    def turn(cls, url: str, pace: float) -> float:
        """Takes the next turn; the seconds until then."""
        with cls.lock:
            now = time.monotonic()
            at = max(now, cls.free.get(url, 0.0))
            cls.free[url] = at + pace
            return at - now

    @classmethod
    def hold(cls, url: str, seconds: float) -> None:
        """Nobody calls before then: a server's pause is everyone's."""
        with cls.lock:
            cls.free[url] = max(cls.free.get(url, 0.0), time.monotonic() + seconds)


def retry_after(value: str | None) -> float | None:
    """Seconds that a Retry-After header asks for: a number or a date."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        at = email.utils.parsedate_to_datetime(value)
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
    return max(0.0, (at - datetime.datetime.now(datetime.UTC)).total_seconds())


def post(to: Endpoint, path: str, payload: dict) -> str:
    """The body of an answer; TimeoutError past the hard end, OSError where the last try fails or the server refuses."""
    end = time.monotonic() + to.timeout
    body, headers = json.dumps(payload).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {to.key}"} if to.key else {})

    def left(pause: float = 0.0) -> float:
        if (seconds := end - time.monotonic() - pause) <= 0:
            raise TimeoutError(f"{to.url} took more than {to.timeout} seconds")
        return seconds

    for attempt in range(to.tries):
        pause = _Pace.turn(to.url, to.pace)
        left(pause)
        time.sleep(pause)
        told = None
        try:
            with urllib.request.urlopen(urllib.request.Request(to.url.rstrip("/") + path, body, headers), timeout=left()) as answer:
                parts = []
                while part := answer.read1(1 << 16):
                    parts.append(part)
                    left()
                return b"".join(parts).decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt == to.tries - 1:
                raise
            told = retry_after(e.headers.get("Retry-After"))
        except OSError as e:
            left()
            if attempt == to.tries - 1:
                raise OSError(f"{to.url}: {e}") from e
        pause = told if told is not None else to.delay * 2**attempt
        left(pause)
        if told is not None:
            _Pace.hold(to.url, told)
        time.sleep(pause)
    raise OSError(f"{to.url}: no tries")


def _each(to: Endpoint, calls: list, f: Callable) -> list:
    with ThreadPoolExecutor(max(1, to.threads)) as pool:
        return list(pool.map(f, calls))


def embedder(to: Endpoint, batch: int = BATCH):
    """Text column -> ARRAY<FLOAT> of length one; equal texts of an Arrow batch are asked once, null texts have no vector, a failed call fails the task (Spark tries it again)."""

    def vectors(texts: list[str]) -> list[np.ndarray]:
        found = json.loads(post(to, "/api/embed", {"model": to.model, "input": texts})).get("embeddings")
        matrix = np.asarray(found if isinstance(found, list) else [], np.float32)
        if matrix.ndim != 2 or len(matrix) != len(texts):
            raise ValueError(f"{to.url} gave no vector for each text")
        return list(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12))

    @pandas_udf(ArrayType(FloatType()))
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            calls = [distinct[i : i + batch] for i in range(0, len(distinct), batch)]
            known = dict(zip(distinct, (v for found in _each(to, calls, vectors) for v in found), strict=True))
            yield pd.Series([None if t is None else known[t] for t in texts], dtype=object)

    return embed


def _answer(to: Endpoint, content: object) -> str | None:
    try:
        return post(to, "/v1/chat/completions", {"model": to.model, "temperature": 0, "messages": [{"role": "user", "content": content}]})
    except (OSError, ValueError):
        return None


def chat(to: Endpoint):
    """Prompt column -> raw answers (see ``responses.message``); null where the prompt is, and where no call succeeds: callers have another way."""

    @pandas_udf(StringType())
    def ask(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in series:
            distinct = list(dict.fromkeys(p for p in prompts if p is not None))
            known = dict(zip(distinct, _each(to, distinct, lambda p: _answer(to, p)), strict=True))
            yield pd.Series([known.get(p) if p is not None else None for p in prompts], dtype=object)

    return ask


def vision(to: Endpoint, prompt: str, mime: str = "image/png"):
    """Image content column (binary) -> raw answers about each image; null as for ``chat``."""

    @pandas_udf(StringType())
    def look(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(content: bytes | None) -> str | None:
            if content is None:
                return None
            url = f"data:{mime};base64,{base64.b64encode(content).decode()}"
            return _answer(to, [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}])

        for contents in series:
            yield pd.Series(_each(to, list(contents), one), dtype=object)

    return look
