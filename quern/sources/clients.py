"""Clients of things outside: OCR programs, and retries round any call.  They run inside Arrow batches on the executors."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OFF = {"none", "off", "disabled", "skip"}
OCR: dict[str, Callable] = {}  # other clients by name: path column -> text column


def retried(f: Callable, tries: int = 3, delay: float = 1.0, wait: Callable[[Exception], float | None] | None = None) -> Callable:
    """The call, repeated after errors with growing pauses (or those that ``wait`` reads from the error)."""

    @wraps(f)
    def call(*args, **kwargs):
        for attempt in range(tries):
            try:
                return f(*args, **kwargs)
            except Exception as e:
                if attempt == tries - 1:
                    raise
                told = wait(e) if wait else None
                time.sleep(told if told is not None else delay * 2**attempt)

    return call


def throttled(f: Callable, least: float) -> Callable:
    """The call, at most once in so many seconds in this process."""
    last = [0.0]

    @wraps(f)
    def call(*args, **kwargs):
        time.sleep(max(0.0, last[0] + least - time.monotonic()))
        last[0] = time.monotonic()
        return f(*args, **kwargs)

    return call


def tesseract(languages: str = "eng", psm: str = "6", timeout: int = 90) -> Callable:
    """A column function that runs the program on image paths; a failed run gives no text."""

    @F.pandas_udf(StringType())
    def run(paths: pd.Series) -> pd.Series:
        def one(path: str | None) -> str:
            if path is None:
                return ""
            try:
                done = subprocess.run(["tesseract", path, "stdout", "-l", languages, "--psm", psm], capture_output=True, timeout=timeout, check=True)
            except (OSError, subprocess.SubprocessError):
                return ""
            return "\n".join(x for x in (" ".join(s.split()) for s in done.stdout.decode("utf-8", "replace").splitlines()) if x)

        return paths.map(one)

    return run


def ocr_client(name: str) -> Callable:
    """The client of a name: off, ``tesseract[:languages[:psm]]``, or one that OCR holds."""
    key = (name or "").strip()
    if not key:
        raise ValueError("an OCR client has to be named")
    if key.lower() in OFF:
        return lambda path: F.lit(None).cast("string")
    kind, _, rest = key.partition(":")
    if kind.lower() == "tesseract":
        parts = [p for p in rest.split(":") if p]
        return tesseract(*parts[:2])
    if key not in OCR:
        raise RuntimeError(f"OCR client {key!r} is not registered")
    return OCR[key]
