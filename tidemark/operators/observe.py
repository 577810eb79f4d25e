"""Sync observability: totals, rates, lag, errors, health, alerts, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.enrich import if_few
from tidemark.operators.segments import Segments, trailing


def money(c: str | Column) -> Column:
    """Exact sum of a column with two decimals, whatever the order of the rows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"))


def totals(events: DataFrame, keys: list[str], size: Column) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.sum(size).alias("bytes"))


def trailing_rate(rows: DataFrame, keys: list[str], ts: str, value: Column, seconds: int = 60) -> DataFrame:
    """Sum of a value with two decimals over the last seconds up to each row, per second; a key may have any share of the rows."""
    out = trailing(rows, keys, ts, value, seconds * 1_000_000 - 1, "__sum")
    return out.withColumn("rate", F.col("__sum").cast("double") / seconds).drop("__sum")


def lag_latest(rows: DataFrame, keys: list[str], processed: Column, ts: str = "cluster_time") -> DataFrame:
    """Seconds from a change to its processing, of the newest change of each table."""
    lag = (micros(processed) - micros(F.col(ts))) / 1e6
    return rows.groupBy(*keys).agg(F.round(F.max_by(lag, F.struct(ts, "seq")), 4).alias("lag_seconds"))


def mean_lag(lags: DataFrame) -> DataFrame:
    """Mean over tables of the lag of each, as lag_latest gives it."""
    return lags.agg(F.round(F.avg("lag_seconds"), 4).alias("mean_lag"), F.count("lag_seconds").alias("tables"))


def errors_rollup(errors: DataFrame, keys: list[str], message: str, ts: str, tie: str, details: str | None = None) -> DataFrame:
    """Count, last message and last time of each key, such as (db, coll, error_type), and the details of the last error where they are a column."""
    last = {"last_message": message} | ({"last_details": details} if details else {})
    return errors.groupBy(*keys).agg(F.count("*").alias("n"), *[F.max_by(c, F.struct(ts, tie)).alias(k) for k, c in last.items()], F.max(ts).alias("last_time"))


def health_value(status: Column) -> Column:
    return F.when(status == "healthy", 1.0).when(status == "degraded", 0.5).when(status == "unhealthy", 0.0).otherwise(-1.0)


def log_stats(logs: DataFrame) -> DataFrame:
    """Counts by level, by stage and overall, in one pass."""
    n = F.count("*").alias("n")
    return logs.groupingSets([["level"], ["stage"], []], "level", "stage").agg(F.grouping_id().alias("g"), n, F.max("ts").alias("last_ts"))


def error_rate(logs: DataFrame) -> DataFrame:
    return logs.agg(F.round(F.avg((F.col("level") == "error").cast("int")) * 100, 4).alias("error_rate"))


def log_search(logs: DataFrame, text: str | None = None, stage: str | None = None, status: str | None = None, columns: tuple[str, ...] = ("message",), details: str | None = None) -> DataFrame:
    """Entries of a stage and status whose columns, or string details, contain a text in either case."""
    out = logs
    if stage is not None:
        out = out.filter(F.col("stage") == stage)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if text:
        hits = [F.lower(c).contains(text.lower()) for c in columns]
        if details:
            hits.append(F.exists(F.map_values(details), lambda v: F.lower(v).contains(text.lower())))
        out = out.filter(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), hits, F.lit(False)))
    return out


def newest_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page (from 1, at most 100 rows) of the newest first, with the rows found and their pages; a top-k that keeps page * size rows per task."""
    size = max(1, min(100, size))
    found = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return top.join(F.broadcast(found)).withColumn("total_pages", F.floor((F.col("total") + size - 1) / size))  # one row


def breaches(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rules against metrics of the same type. What else a rule names of name, component, db and coll must be equal too; a blank there, or no
    such column, holds for all. `rules` is broadcast if they are few, as counted."""
    r = if_few(rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns]))
    on = F.col("r_type") == F.col("type")
    for c in [c for c in ("name", "component", "db", "coll") if c in rules.columns]:
        blank = F.coalesce(f"r_{c}", F.lit("")) == ""
        on &= blank | (F.col(f"r_{c}") == F.col(c)) if c in metrics.columns else blank
    value, limit = F.col("value"), F.col("r_limit")
    over = reduce(lambda c, o: c.when(F.col("r_op") == o[0], o[1]), (("gte", value >= limit), ("lt", value < limit), ("lte", value <= limit), ("eq", value == limit)), F.when(F.col("r_op") == "gt", value > limit))
    over = over.otherwise(F.lit(False))
    return metrics.join(r, on).withColumn("breach", over)


def alert_edges(rows: DataFrame, keys: list[str], order: list[str], breach: str) -> DataFrame:
    """Batch form of the alert machine without cooldown: raised where a breach begins, resolved where it ends. `order` should have no ties."""
    s = Segments(rows, keys, order)
    before = F.lag(F.col(breach), 1, False).over(s.window)
    state = F.when(F.col(breach) & ~before, "raised").when(~F.col(breach) & before, "resolved")
    return s.clean(s.with_last(1).withColumn("state", state)).filter("state IS NOT NULL")


#: The default alert rules (type, comparison, limit, severity).
DEFAULT_RULES = (("lag", "gt", 30.0, "warning"), ("lag", "gt", 120.0, "critical"), ("throughput", "lt", 1.0, "warning"), ("errors", "gt", 10.0, "critical"),
                 ("component_health", "lt", 0.5, "critical"), ("memory", "gt", 1073741824.0, "warning"))
