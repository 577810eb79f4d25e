"""Changelog streams from files; the position is the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Event types of the sample stream as operations.
OPS = {"signup": "insert", "click": "update", "view": "update", "purchase": "replace", "error": "delete"}


def as_changes(events: DataFrame) -> DataFrame:
    """The changelog view of an event table."""
    op = F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv])[F.col("event_type")]
    return events.select(F.lit("shop").alias("db"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("coll"), op.alias("op"), F.col("user_id").alias("doc_key"),
                         F.struct("value", "props").alias("doc"), F.col("ts").alias("cluster_time"), F.col("event_id").alias("seq"), "event_type")


def stream(spark: SparkSession, folder: str, glob: str = "*.parquet", schema: str | T.StructType = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
