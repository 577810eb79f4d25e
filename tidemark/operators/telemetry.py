"""Telemetry analytics per node: scores, trends, anomalies, seasons, neighbours.

Scans in the order of time run over parts of equal size (see segments), whatever share of the rows a node has. Where a step needs an ordered fold, the
rows folded are a capped history by definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, micros
from tidemark.operators.segments import Segments, moments_before, trailing

#: Weights of the neighbour distance and of the pattern score.
NEAR = {"cpu": 0.3, "mem": 0.25, "latency": 0.2, "conn": 0.1}
MATCH = {"cpu": 0.3, "mem": 0.25, "latency": 0.2, "slot": 0.1, "day": 0.05, "volume": 0.1}


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def environment(rows: DataFrame, node: str = "node") -> DataFrame:
    """Profile of the last 50 observations of each node (with ts and seq)."""
    recent = last_n(rows, [node], [F.desc("ts"), F.desc("seq")], 50)
    p = recent.groupBy(node).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("cpu", "mem", "latency") for k, f in (("mean", F.avg), ("peak", F.max))],
                                 (F.var_pop("conn") / F.avg("conn")).alias("cv"))
    kind = F.when(F.col("n") < 5, "unknown").when(F.col("cv") < 0.2, "steady").when(F.col("cv") > 0.8, "bursty").otherwise("cyclical")
    limit = F.when(F.col("mean_cpu") > 80, "cpu").when(F.col("mean_mem") > 80, "memory").when(F.col("mean_latency") > 5000, "network").otherwise("balanced")
    load = F.when(F.col("mean_latency") < 100, "oltp").when(F.col("mean_latency") > 1000, "olap").otherwise("mixed")
    return p.select(node, "n", *[F.round(c, 9).alias(c) for c in p.columns if c.startswith(("mean", "peak"))], kind.alias("traffic"), limit.alias("constraint"), load.alias("workload"))


def confidence(rows: DataFrame, node: str, success: Column) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(node).agg(n.alias("n"), F.when(n < 10, F.lit(0.0)).otherwise(F.round(F.avg(success.cast("int")) * F.least(F.lit(1.0), n / 100), 9)).alias("confidence"))


# The weights and limits of the scores below (band, usage_score, load_flags, node_load, capability).
def band(u: Column, low: float, high: float) -> Column:
    """1 in the ideal band, less below and above."""
    return F.when(u < low, 0.5 + 0.5 * u / low).when(u > high, F.greatest(F.lit(0.1), 1 - (u - high) / (100 - high))).otherwise(F.lit(1.0))


def usage_score(cpu: Column, mem: Column, latency: Column, stability: Column, trend: Column) -> Column:
    resource = (band(cpu, 50, 70) + band(mem, 40, 60)) / 2
    return clamp(0.3 * resource + 0.4 * (1 - F.least(F.lit(1.0), latency / 500)) + 0.2 * stability + 0.1 * trend, 0.0, 1.0)


def load_flags(rows: DataFrame) -> DataFrame:
    over = (F.col("cpu") > 75) | (F.col("mem") > 80) | (F.col("latency") > 500) | (F.col("queue") > 500)
    excess = F.greatest((F.col("cpu") - 75) / 25, (F.col("mem") - 80) / 20, (F.col("latency") - 500) / 500, (F.col("queue") - 500) / 500)
    spare = F.least(1 - F.col("cpu") / 100, 1 - F.col("mem") / 100)
    return rows.withColumns({"overloaded": over, "throttle_ms": F.round(50 + 1950 * clamp(excess, 0.0, 1.0), 9), "scale": F.round(clamp(1.05 + 0.2 * spare, 1.05, 1.25), 9)})


def effectiveness(rows: DataFrame, keys: list[str], score: str, top: int = 20, history: int = 1000) -> DataFrame:
    """0.7 old + 0.3 new in event order, and the best patterns; all uses count. Uses before the last `history` weigh less than 0.7 ** history, below
    any double's precision, so the fold leaves them out."""
    recent = last_n(rows, keys, [F.desc("ts"), F.desc("seq")], history)
    seen = F.array_sort(F.collect_list(F.struct("ts", "seq", F.col(score).alias("s"))))
    fold = F.aggregate(F.slice("seen", 2, history), F.element_at("seen", 1)["s"], lambda a, x: 0.7 * a + 0.3 * x["s"])
    uses = rows.groupBy(*keys).agg(F.count("*").alias("uses"))
    out = recent.groupBy(*keys).agg(seen.alias("seen")).join(uses, keys).select(*keys, F.round(fold, 9).alias("effectiveness"), "uses", F.round(F.least(F.lit(1.0), 0.1 * F.col("uses")), 9).alias("confidence"))
    return out.orderBy(F.desc("effectiveness"), *keys).limit(top)


def neighbours(queries: DataFrame, examples: DataFrame, k: int = 5, most: int = 10_000) -> DataFrame:
    """Settings averaged over the k nearest other examples by performance, as qid, setting, mean_distance.

    `examples` is a capped history: more than `most` rows are an error. It goes to every task, which measures a slice of queries against it at
    once and keeps the k least of each, so nothing is shuffled or sorted.
    """
    kept = examples.limit(most + 1).toPandas().sort_values("qid")  # ties go to the smaller qid
    if len(kept) > most:
        raise ValueError(f"more than {most} examples")
    shared, names = queries.sparkSession.sparkContext.broadcast(kept), list(NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        at, ids, setting, score = e[names].to_numpy(float), e["qid"].to_numpy(), e["setting"].to_numpy(float), e["score"].to_numpy(float)
        for whole in batches:
            for i in range(0, len(whole), 1000):
                x = whole.slice(i, 1000)
                q, qid = np.stack([x[c].to_numpy(zero_copy_only=False).astype(float) for c in names], 1), x["qid"].to_numpy()
                d = np.zeros((len(q), len(e)))
                for j, w in enumerate(NEAR.values()):
                    d += w * (q[:, j, None] - at[None, :, j]) ** 2
                d = np.round(np.sqrt(d), 9)
                d[qid[:, None] == ids[None, :]] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(d, best, 1)
                own = np.isfinite(near)
                weight = score[best] * own
                some = own.any(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out = (qid, np.round((setting[best] * weight).sum(1) / weight.sum(1), 9), np.round(np.where(own, near, 0).sum(1) / own.sum(1), 9))
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in out], ["qid", "setting", "mean_distance"])

    return queries.select("qid", *names).mapInArrow(run, "qid long, setting double, mean_distance double")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared part of two ranges, relative to the smaller."""
    shared = F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))
    small = F.least(a2 - a1, b2 - b1)
    return F.when(small > 0, shared / small).otherwise(((a1 <= b2) & (b1 <= a2)).cast("double"))


def trend3(rows: DataFrame, node: str = "node") -> DataFrame:
    """Mean and last-minus-first of the last three snapshots, and what to do."""
    s = Segments(rows, [node], ["ts", "seq"])
    w = s.window.rowsBetween(-2, 0)
    out = s.with_last(2).withColumns({f"m_{c}": F.avg(c).over(w) for c in ("cpu", "mem", "latency")} | {f"d_{c}": F.last(c).over(w) - F.first(c).over(w) for c in ("cpu", "mem", "latency")})
    action = (F.when((F.col("m_cpu") > 80) & (F.col("d_cpu") > 0), "shrink").when((F.col("m_mem") > 85) & (F.col("d_mem") > 0), "smaller_batch")
              .when((F.col("m_latency") > 5000) & (F.col("d_latency") > 0), "back_pressure").when((F.col("m_cpu") < 30) & (F.col("m_mem") < 50) & (F.col("m_latency") < 1000), "grow").otherwise("keep"))
    return s.clean(out.withColumn("action", action))


def metric_trend(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rate per hour from the last value, direction, confidence, and whether to flag a change."""
    s = Segments(rows, keys, ["ts", "seq"])
    w = s.window
    hours = (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 3.6e9
    out = s.with_last(10).withColumn("rate", F.when(hours > 0, (F.col(value) - F.lag(value).over(w)) / hours)).withColumn("n", F.row_number().over(w))
    way = F.when(F.col("rate").isNull(), "none").when(F.abs("rate") < 0.1, "stable").when(F.col("rate") > 0, "increasing").otherwise("decreasing")
    out = s.clean(out)  # with ten rows before it, a row has full confidence
    return out.withColumns({"direction": way, "tenths": F.least(F.lit(10), F.col("n") - 1)}).withColumn("flag", (F.col("tenths") > 7) & F.coalesce(F.abs("rate") > 5, F.lit(False)))


def anomalies(rows: DataFrame, keys: list[str], value: str, least: int = 10, sds: float = 2.0) -> DataFrame:
    """Values outside mean +- 2 standard deviations of all earlier ones of their key."""
    out = moments_before(rows, keys, ["ts", "seq"], value)
    return out.withColumn("anomaly", (F.col("n") >= least) & F.coalesce(F.abs(F.col(value) - F.col("mean")) > sds * F.col("sd"), F.lit(False)))


def deltas(rows: DataFrame, keys: list[str], counter: str) -> DataFrame:
    s = Segments(rows, keys, ["ts", "seq"])
    return s.clean(s.with_last(1).withColumn("delta", F.col(counter) - F.coalesce(F.lag(counter).over(s.window), F.lit(0))))


def half_mean(rows: DataFrame, keys: list[str], value: str, history: int = 1000) -> DataFrame:
    """avg <- (avg + x) / 2 in order, over the last `history` values: older ones weigh less than 2 ** -history."""
    seen = F.array_sort(F.collect_list(F.struct("ts", "seq", F.col(value).alias("v"))))
    out = last_n(rows, keys, [F.desc("ts"), F.desc("seq")], history).groupBy(*keys).agg(seen.alias("s"))
    return out.select(*keys, F.round(F.aggregate(F.slice("s", 2, history), F.element_at("s", 1)["v"], lambda a, x: (a + x["v"]) / 2), 9).alias("half_mean"))


def stability(rows: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """Less the more rows the key has within the last seconds."""
    out = trailing(rows, keys, "ts", F.lit(1), seconds * 1_000_000, "__n", "decimal(38,0)")
    return out.withColumn("stability", F.greatest(F.lit(0.1), 1 - F.col("__n").cast("long") / 10)).drop("__n")


def trend_score(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    s = Segments(rows, keys, ["ts", "seq"])
    w = s.window.rowsBetween(-2, 0)
    return s.clean(s.with_last(2).withColumn("trend_score", F.when(F.count("*").over(w) < 3, F.lit(0.5)).otherwise(F.avg(value).over(w))))


def seasons(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, F.date_format("ts", "HH:00").alias("slot")).agg(F.bool_or(F.col("cpu") > 70).alias("peak"), F.bool_or(F.col("cpu") < 30).alias("low"),
                                                                             F.round(F.least(F.lit(1.0), F.count("*") / 100), 9).alias("confidence"))


def node_load(cpu: Column, mem: Column, active: Column, most: Column, errors: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.4 * part(cpu) / 100 + 0.3 * part(mem) / 100 + 0.2 * F.least(F.lit(1.0), part(active / most)) + 0.1 * F.least(F.lit(1.0), part(errors) / 100)


def capability(table_mb: Column, free: Column, most: Column, tcp: Column, gb: Column, concurrency: Column) -> Column:
    return 50 * F.greatest(free, F.lit(0)) / most + F.when((table_mb > 1000) & tcp, 20).otherwise(0) + 5 * gb + 2 * concurrency


def eligible(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables (name, db, ...) of a spec with the nodes that may take them: a node with the table's database in `excluded` may not, one with names in `preferred`
    takes those alone. A table that no node may take gets all."""
    both = nodes.join(F.broadcast(tables))  # a spec lists few tables
    fits = ~F.array_contains("excluded", F.col("db")) & ((F.size("preferred") == 0) | F.array_contains("preferred", F.col("db")))
    some = both.filter(fits).groupBy("name").agg(F.lit(True).alias("__some"))
    return both.withColumn("__fits", fits).join(F.broadcast(some), "name", "left").filter(F.col("__fits") | F.col("__some").isNull()).drop("__fits", "__some")


def ranked(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Place by score, the highest first; rows are few for each key (nodes)."""
    return rows.withColumn("place", F.rank().over(W.partitionBy(*keys).orderBy(F.desc(score))))
