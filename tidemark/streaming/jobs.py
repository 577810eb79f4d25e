"""Streaming jobs on Structured Streaming; each runs all that is available and ends, or goes on with another trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import change_filter, image_filter
from tidemark.operators.snapshot import authorised
from tidemark.sources.versioned import VersionedTarget


def run(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run to the end of what there is; a new run with the same checkpoint goes on after the last batch that was committed."""
    df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_stream(changes: DataFrame, target: VersionedTarget, checkpoint: str, doc_fields: list[str], tables: DataFrame | None = None, criteria: list[dict] | None = None,
                 include: tuple[str, ...] = (), stream: str = "", client: str | None = None, dense: bool = True, snapshot: Callable[[], tuple[DataFrame, DataFrame]] | None = None) -> None:
    """Filter to the tables listed, filter rows and fields, skip what was applied, collapse, upsert and delete, on record in the target's ledger. A repeated
    batch changes nothing.

    `snapshot` gives the whole table and its fence. Where a batch says that the log is invalid, the target starts over from it, and the changes after the
    fence, in this batch and later ones, are merged by position.
    """
    def one(rows: DataFrame, batch: int) -> None:
        rows = rows if tables is None else authorised(rows, tables)
        if snapshot and not rows.filter("op = 'invalidate'").isEmpty():
            target.bootstrap(*snapshot(), batch, f"{stream}/snapshot", "db", "coll")
        rows = image_filter(change_filter(rows, criteria), include) if include else change_filter(rows, criteria)
        target.recorded(stream, batch, lambda: target.apply(rows, batch, doc_fields, stream, client, dense))

    run(changes, one, checkpoint)


def event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """The time column as a timestamp with a watermark (streams can't use one without a zone)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def dedup(changes: DataFrame, keys: list[str], ttl: str = "5 minutes", ts: str = "cluster_time") -> DataFrame:
    return event_time(changes, ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return event_time(df, ts, late).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def positions(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Per client and table the last position and the number of events, as running state."""
    return changes.groupBy(*keys).agg(F.max("seq").alias("last_seq"), F.max("cluster_time").alias("last_time"), F.count("*").alias("n"))
