"""Connected components of an edge table: partition-local forests, then alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.plans.shared import materialise, remove

_SCHEMA = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of one partition's edges as (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(u, v), longs without nulls -> (node, root): every node that is not its component's smallest, with that smallest.

    Nothing is collected. Each round is a written table, so a lost executor costs one round at most. Hubs are met
    by partial minima and by joins whose large side Spark can split. Self loops and repeated edges are harmless; no
    edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = materialise(spark, edges.mapInArrow(_forest, _SCHEMA), "components")
    mark, files = None, None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.where("v < u")
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        small = small.where("u <> v").distinct()
        after = materialise(spark, small.coalesce(files) if files else small, "components")  # few rows go into few files
        row = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        remove(spark, now)
        now = after
        if mark == (row.n, row.x) or not row.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, files = (row.n, row.x), 1 + row.n // 100_000
