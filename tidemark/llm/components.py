"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, spread, written

#: So many edges at a time are contracted within a task.
AT_ONCE = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of the same components, one for each node but the smallest of those that AT_ONCE edges of a task connect."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def flush():
        star = [(x, r) for x in list(up) if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in star], kind) for k in (0, 1)], names=["u", "v"])

    n, kind = 0, None
    for x in batches:
        kind, n = x["u"].type, n + x.num_rows
        for u, v in zip(x["u"].to_pylist(), x["v"].to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if n >= AT_ONCE:
            yield flush()
            n = 0
    if n:
        yield flush()


def _state(now: DataFrame) -> tuple[int, int]:
    """How many nodes there are, and how many of them lack what ends the rounds: one edge downwards, to a node that has none."""
    ends = now.select(F.col("u").alias("x"), "v").unionByName(now.select(F.col("v").alias("x"), F.lit(None).cast(now.schema["v"].dataType).alias("v")))
    each = ends.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all"), F.count("v").alias("down"))
    nodes, unsettled = each.agg(F.count("*"), F.count_if(F.expr("lo <> hi OR down > 0 AND all > down"))).first()
    return nodes, unsettled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge to another; component is the smallest id reachable.

    Edges are contracted within each task first, which leaves little to the rounds. Each round joins every node to the smallest of its
    neighbours. Minima are combined before the shuffle, so a node with very many edges costs one row per task. Where nodes are many, neither a round
    nor a join with the result broadcasts them.
    """
    spark = edges.sparkSession
    few = max(4, spark.sparkContext.defaultParallelism)  # edges are small: a task a core
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    kind = now.schema["u"].dataType.simpleString()
    now, path = written(now.coalesce(few).mapInArrow(_forest, f"u {kind}, v {kind}"))
    while (state := _state(now))[1]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(low, state[0]), "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large, large_path = written(large.distinct().coalesce(few))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(low, state[0]), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct()
        now, new_path = written(small.coalesce(few))
        forget(spark, path, large_path)
        path = new_path
    tree = now.select(F.col("u").alias("id"), F.col("v").alias("component")).distinct()
    return spread(tree.unionByName(tree.select(F.col("component").alias("id"), "component").distinct()), state[0])
