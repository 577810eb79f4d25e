"""Patterns of conditions: telemetry falls into buckets, buckets whose conditions match are one pattern, and each pattern keeps a weighted effectiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import day_kind, time_of_day, volume_class
from tidemark.operators.enrich import if_few
from tidemark.operators.telemetry import MATCH, overlap
from tidemark.sources.storage import scratch

MEASURES = ("cpu", "mem", "latency")


def bucketed(rows: DataFrame) -> DataFrame:
    """Add the deciles of cpu, mem and latency, the time of day, the kind of day, the class of connections, and `bucket`, their name.

    One pass finds the cuts of all three: counts of values rounded to two decimals, so its memory is bounded by the range of the measures.
    """
    tenths = F.array(*[F.lit(i / 10) for i in range(1, 10)])
    cuts = rows.agg(*[F.percentile(F.round(c, 2), tenths).alias(c) for c in MEASURES]).first()
    at = {f"d_{c}": sum(((F.round(c, 2) > F.lit(round(x, 6))).cast("int") for x in cuts[c] or ()), F.lit(0)) for c in MEASURES}
    out = rows.withColumns({**at, "slot": time_of_day(F.col("ts")), "day": day_kind(F.col("ts")), "volume": volume_class(F.col("conn"))})
    return out.withColumn("bucket", F.concat_ws("/", "d_cpu", "d_mem", "d_latency", "slot", "day", "volume"))


def matching(buckets: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of buckets (a, b) whose conditions match by `least` or more. Without the same decile of cpu and of mem the weights can't reach that, so
    buckets meet by these: at most ten latencies times the slots, days and volumes there are."""
    span = [F.min(c).alias(f"{c}_lo") for c in MEASURES] + [F.max(c).alias(f"{c}_hi") for c in MEASURES]
    told = buckets.groupBy("bucket", "d_cpu", "d_mem", "slot", "day", "volume").agg(*span)
    other = told.select("d_cpu", "d_mem", *[F.col(c).alias(f"o_{c}") for c in told.columns if c not in ("d_cpu", "d_mem")])
    both = told.join(other, ["d_cpu", "d_mem"]).filter(F.col("bucket") < F.col("o_bucket"))
    score: Column = sum((MATCH[c] * overlap(F.col(f"{c}_lo"), F.col(f"{c}_hi"), F.col(f"o_{c}_lo"), F.col(f"o_{c}_hi")) for c in MEASURES), F.lit(0.0))
    score += sum((MATCH[c] * (F.col(c) == F.col(f"o_{c}")).cast("int") for c in ("slot", "day", "volume")), F.lit(0.0))
    return both.filter(F.round(score, 9) >= least).select(F.col("bucket").alias("a"), F.col("o_bucket").alias("b"))


def joined(pairs: DataFrame) -> DataFrame:
    """(bucket, pattern): the smallest bucket that pairs lead to. Labels pass along pairs until none changes; buckets are thousands at most."""
    spark = pairs.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        to = scratch(spark)
        df.write.parquet(to)
        return spark.read.schema(df.schema).parquet(to)

    ways = kept(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = kept(ways.select(F.col("a").alias("bucket"), F.col("a").alias("pattern")).distinct())
    while True:
        seen = ways.join(now, F.col("b") == F.col("bucket")).groupBy("a").agg(F.min("pattern").alias("least"))
        after = kept(now.join(seen, F.col("bucket") == F.col("a")).select("bucket", F.least("pattern", "least").alias("pattern"), (F.col("least") < F.col("pattern")).alias("moved")))
        if after.filter("moved").isEmpty():
            return now
        now = after.drop("moved")


def with_pattern(rows: DataFrame) -> DataFrame:
    """Rows (cpu, mem, latency, conn, ts) with the pattern of their bucket; a bucket that matches no other is a pattern by itself."""
    told = bucketed(rows)
    return told.join(if_few(joined(matching(told))), "bucket", "left").withColumn("pattern", F.coalesce("pattern", "bucket"))
