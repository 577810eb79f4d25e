"""Enrichment and profiles of copied tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most rows of a table that is broadcast; they are keys and a few numbers each.
FEW = 200_000


def if_few(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its rows are few, as counted."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def authorised_keys(rows: DataFrame, grants: DataFrame, allowed: Column, key: str, grant_key: str) -> DataFrame:
    """Rows whose key is granted; without grants none."""
    keys = grants.filter(allowed & F.col(grant_key).isNotNull()).select(F.col(grant_key).alias("__k")).distinct()
    return rows.join(keys, F.col(key) == F.col("__k"), "left_semi")


def entropy(df: DataFrame, text: Column) -> DataFrame:
    """Byte entropy of a column and the compression it promises. Bytes are counted per batch, then summed: 256 groups at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = sum((np.bincount(np.frombuffer(v, np.uint8), minlength=256) for v in x["x"].to_pylist() if v), np.zeros(256, np.int64))
            yield pa.RecordBatch.from_pydict({"b": pa.array(np.flatnonzero(n)), "n": pa.array(n[n > 0])})

    counts = df.select(text.cast("binary").alias("x")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    h = counts.crossJoin(F.broadcast(total)).agg(F.max("t").alias("bytes"), (-F.sum(p * F.log2(p))).alias("h"))
    return h.select("bytes", F.round("h", 4).alias("entropy"), F.round(0.3 + 0.4 * F.col("h") / 8, 4).alias("zstd_ratio"), F.round(0.5 + 0.3 * F.col("h") / 8, 4).alias("lz4_ratio"))


def summary(df: DataFrame, conditions: dict[str, Column], value: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()], F.round(F.avg(value), 2).alias("mean"))
