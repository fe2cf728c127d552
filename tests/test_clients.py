import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import responses as R
from quern.operators import datasets
from quern.sources import clients


def test_model_segments_are_checked(spark):
    text = "The stone stands by the river. Its letters are old. " * 4 + "TAIL_UNIQUE ends it."
    say = lambda s: lambda prompt: F.lit(s)
    good = '["' + ("The stone stands by the river. Its letters are old. " * 2).strip() + '", "' + ("The stone stands by the river. Its letters are old. " * 2).strip() + ' TAIL_UNIQUE ends it."]'
    df = spark.createDataFrame([(text,)], "t string")
    chunks = lambda *ask: df.select(R.model_chunks(F.col("t"), F.lit("x"), list(ask), 150, 0)).first()[0]
    refused = chunks(say('["A short summary"]'))
    assert "summary" not in " ".join(refused) and "TAIL_UNIQUE" in " ".join(refused) and all(len(c) <= 150 for c in refused)
    assert len(chunks(say("no"), say(good))) == 2  # the second answer is taken
    assert df.select(R.model_chunks(F.lit("short one"), F.lit("x"), [say("no")], 150, 0)).first()[0] == ["short one"]


def test_clients():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("not yet")
        return x

    assert clients.retried(flaky, 3, 0)(5) == 5 and len(calls) == 3
    with pytest.raises(OSError):
        clients.retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0)()
    with pytest.raises(ValueError):
        clients.ocr_client(" ")
    with pytest.raises(RuntimeError):
        clients.ocr_client("unknown")


def test_ocr_off_and_missing_program(spark):
    df = spark.createDataFrame([("/no/such.png",)], "p string")
    assert df.select(clients.ocr_client("off")(F.col("p")).alias("a"), clients.ocr_client("tesseract:eng:6")(F.col("p")).alias("b")).first() == (None, "")


def test_sizes_and_classes(spark):
    r = spark.range(1).select(datasets.prepared_size(F.lit(256), F.lit(1024)).alias("a"), datasets.prepared_size(F.lit(900), F.lit(600)).alias("b")).first()
    assert tuple(r.a) == (512, 2048) and tuple(r.b) == (900, 600)
    w, h = datasets.patch_size((0, 0, 40, 10), 400, 300, np.random.default_rng(1), (0.1, 0.2))
    assert w > h >= 18 and w <= 396
    assert datasets.resolve_class(["A", "b"], class_name="a") == 0 and datasets.resolve_class(["A"], 0) == 0
    with pytest.raises(ValueError):
        datasets.resolve_class(["A"], 3)
