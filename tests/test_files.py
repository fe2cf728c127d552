"""The sink of dataset files: two phases, failures between them, odd rows."""

import os
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quern.operators import datasets
from quern.sources import files

ROWS = "path string, content binary, size int, note string"


def on_disk(root):
    """Every file but those of the manifest."""
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.relpath(os.path.join(folder, name), root)
            if not path.startswith("manifest"):
                with open(os.path.join(root, path), "rb") as f:
                    found[path] = f.read()
    return found


def listed(manifest):
    return {r.path: (r.size, r.crc32) for r in manifest.collect()}


def expected(contents):
    return {path: (len(c), crc32(c)) for path, c in contents.items()}


def test_manifest_equals_the_files(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    rows = [(f"images/c{i % 3}/{i:06d}.png", b"x" * (i * 37 % 5000) if i % 7 else None, -1, "n") for i in range(200)]
    got = files.write_files(spark.createDataFrame(rows, ROWS).repartition(6), root)
    want = {p: c or b"" for p, c, *_ in rows}
    assert on_disk(f"{tmp_path}/data") == want and listed(got) == expected(want) and got.columns == ["path", "size", "crc32"]
    with pytest.raises(FileExistsError):
        files.write_files(spark.createDataFrame(rows, ROWS), root)
    assert on_disk(f"{tmp_path}/data") == want and listed(files.resume(spark, root)) == expected(want)


def test_failed_tasks_leave_nothing(spark, tmp_path):
    """A task that fails after others have written, and paths that a dataset cannot hold."""
    for k, bad in enumerate((None, "", "/abs/x", "a/../../x", "a//b", "manifest/x", "_staging/x")):
        root = f"{tmp_path}/{k}"
        rows = [(f"a/{i}", b"1", 1, "") for i in range(50)] + [(bad, b"1", 1, "")]
        with pytest.raises(Exception, match="not a path within a dataset"):
            files.write_files(spark.createDataFrame(rows, ROWS).coalesce(2), f"file://{root}")
        assert on_disk(root) == {} and not os.path.exists(f"{root}/_staging") and files.resume(spark, f"file://{root}") is None


def test_one_path_twice_publishes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/twice"
    with pytest.raises(ValueError, match="a/1"):
        files.write_files(spark.createDataFrame([("a/1", b"x", 1, ""), ("a/2", b"y", 1, ""), ("a/1", b"x", 1, "")], ROWS), root)
    assert on_disk(f"{tmp_path}/twice") == {}


def test_no_rows(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    assert files.write_files(spark.createDataFrame([], ROWS), root).count() == 0 and on_disk(f"{tmp_path}/none") == {} and files.published(root)


def test_stray_attempts_are_swept_and_lost_drivers_resumed(spark, tmp_path):
    root, place = f"file://{tmp_path}/lost", f"{tmp_path}/lost"
    spark.dataSource.register(files.DatasetFiles)
    want = {f"k/{i}": bytes([i]) for i in range(40)}
    rows = spark.createDataFrame([(p, c) for p, c in want.items()], "path string, content binary").repartition(4)
    stray = f"{place}/_staging/job/0-999/files/k"  # an attempt that was killed while it wrote
    os.makedirs(stray)
    with open(f"{stray}/half", "wb") as f:
        f.write(b"?")
    os.makedirs(f"{place}/_staging/never/1-1/files")  # a job that was never committed
    rows.write.format("dataset_files").option("path", root).option("job", "job").mode("append").save()
    assert "0-999" not in os.listdir(f"{place}/_staging/job") and not files.published(root)
    # the driver is lost while files are being moved: some stand in their place
    attempt = next(a for a in sorted(os.listdir(f"{place}/_staging/job")) if "-" in a and os.path.isdir(f"{place}/_staging/job/{a}/files"))
    os.makedirs(f"{place}/k")
    for name in sorted(os.listdir(f"{place}/_staging/job/{attempt}/files/k"))[:2]:
        os.rename(f"{place}/_staging/job/{attempt}/files/k/{name}", f"{place}/k/{name}")
    got = files.resume(spark, root)
    assert on_disk(place) == want and listed(got) == expected(want) and not os.path.exists(f"{place}/_staging")


def test_samples_and_labels_by_class(spark, tmp_path):
    plan = datasets.plan_samples(spark, ["Stone, old", "Ær"], 3, 5)
    made = plan.withColumn("images", F.encode(F.concat(F.lit("i"), "counter"), "UTF-8")).withColumn("masks", F.when(F.col("variant") > 0, F.encode(F.lit("m"), "UTF-8")))
    got = listed(datasets.save_samples(made, f"file://{tmp_path}/s", ("images", "masks")))
    names = {"Stone, old": "Stone__old", "Ær": "Ær"}
    want = {f"{kind}/{names[r.class_name]}/{r.counter:06d}.png": c for r in plan.collect() for kind, c in (("images", f"i{r.counter}".encode()), ("masks", b"m")) if kind == "images" or r.variant}
    assert got == expected(want) and on_disk(f"{tmp_path}/s") == want
    placed = spark.createDataFrame([(1, "p", "train", 100, 50, 0, 1, "Ær", 7, 10, 10, 30, 20, 0.5), (2, "p", "val", 100, 50, 0, 0, "Stone, old", 8, 0, 0, 50, 50, 0.5)], datasets.INSTANCE)
    datasets.save_labels(placed, f"file://{tmp_path}/l")
    texts = {f"labels/{r.split}/{r.scene_id}.txt": r.label.encode() for r in datasets.labels(placed).collect()}
    assert on_disk(f"{tmp_path}/l") == texts and set(texts) == {"labels/train/1.txt", "labels/val/2.txt"}
