"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of an edge list that fits in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def contract(batches: Iterator[pa.RecordBatch], hold: int = 400_000) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as stars with the same components; at most ``hold`` edges are held besides a batch."""
    u = v = np.zeros(0, np.int64)

    def reduced(u, v):
        node, root = labels(u, v)
        return node[node != root], root[node != root]

    def out(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
        if len(u) > hold:
            u, v = reduced(u, v)
            if len(u) > hold // 2:
                yield out(u, v)
                u = v = np.zeros(0, np.int64)
    if len(u):
        yield out(*reduced(u, v))


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes, about
    log(n) rounds; a step is an aggregation with map-side minima and a join
    that Spark may split where one node has many edges.  Every round is
    written to the shared folder.  Self loops are dropped, repeated edges harmless.
    """
    spark = edges.sparkSession

    def fresh(rows, state):
        path = tk.shared_folder(spark, purpose)
        with tk.shuffles_freed(spark):
            rows.write.parquet(path)
        out = spark.read.schema("u bigint, v bigint").parquet(path)
        found = out.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return out, (found.n, found.h), (found.n, found.h) == state

    e, state, _ = fresh(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(contract, "u bigint, v bigint").distinct(), None)
    while state[0]:
        every = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e1 = tk.cut(e1, purpose)
        least = e1.groupBy("u").agg(F.min("v").alias("m"))
        moved = e1.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, state, same = fresh(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), state)
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
