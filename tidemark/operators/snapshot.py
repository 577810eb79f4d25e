"""Snapshots: filtered, projected, routed, sliced and paged copies of tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import column_filter, row_filter
from tidemark.operators.sequence import numbered
from tidemark.plans.spec import TableSpec

ROWS_PER_SLICE, MOST_SLICES, PAGE, MOST_PAGE = 10_000, 50, 1000, 10_000


def snapshot(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Row filter first, then column filter."""
    return column_filter(df.filter(row_filter(df, spec.criteria)), spec.key, spec.include, spec.exclude, spec.always)


def count_only(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.filter(row_filter(df, spec.criteria)).agg(F.count("*").alias("n"))


def keyset(df: DataFrame, key: str, last, spec: TableSpec | None = None) -> DataFrame:
    """Rows past the last key copied; the bound is a literal, so row groups below it are skipped."""
    df = df if spec is None else snapshot(df, spec)
    return df if last is None else df.filter(F.col(key) > F.lit(last))


def n_slices(count: int) -> int:
    return max(1, min(MOST_SLICES, count // ROWS_PER_SLICE))


def slices(df: DataFrame, key: str) -> DataFrame:
    """Every row with its slice, 0 to n - 1: equal numbers of rows in key order, the last slice with the remainder."""
    total = df.count()
    n = n_slices(total)
    step = max(1, total // n)
    return numbered(df, F.col(key)).withColumn("slice", F.least(F.floor((F.col("rn") - 1) / step), F.lit(n - 1)).cast("int")).drop("rn")


def bounds(df: DataFrame, key: str) -> DataFrame:
    """slice, total, low (exclusive), high (inclusive), est_count and n, one row per slice; open ends are null."""
    total = df.count()
    n = n_slices(total)
    step = max(1, total // n)
    per = slices(df, key).groupBy("slice").agg(F.max(key).alias("high"), F.count("*").alias("n"))  # at most MOST_SLICES rows from here on
    low = per.select((F.col("slice") + 1).alias("slice"), F.col("high").alias("low"))
    return per.join(F.broadcast(low), "slice", "left").select(
        "slice", F.lit(n).alias("total"), "low", F.when(F.col("slice") < n - 1, F.col("high")).alias("high"),
        F.when(F.col("slice") == n - 1, F.lit(total - step * (n - 1))).otherwise(F.lit(step)).cast("long").alias("est_count"), "n")


def in_slice(key: Column, low, high) -> Column:
    """The filter of one slice."""
    out = F.lit(True)
    out = out if low is None else out & (key > F.lit(low))
    return out if high is None else out & (key <= F.lit(high))


def paged(df: DataFrame, key: str, size: int = PAGE) -> DataFrame:
    """Every row with its page (from 0), the number of pages (1 at least), has_next and has_prev."""
    size = max(1, min(MOST_PAGE, size))
    total = df.count()
    pages = max(1, -(-total // size))
    page = F.floor((F.col("rn") - 1) / size)
    return numbered(df, F.col(key)).withColumn("page", page).drop("rn").withColumns(
        {"total_pages": F.lit(pages).cast("long"), "has_next": F.col("page") < pages - 1, "has_prev": F.col("page") > 0})


def route(rows: DataFrame, routes: DataFrame, db: str = "db") -> DataFrame:
    """Add target_db: the configured one, else the same. `routes` (db, target_db) comes from a spec, so it is small."""
    own = F.broadcast(routes.select(F.col("db").alias("__db"), F.col("target_db").alias("__to")))
    return rows.join(own, F.col(db) == F.col("__db"), "left").withColumn("target_db", F.coalesce("__to", db)).drop("__db", "__to")


def target_name(spec: TableSpec, template: str | None = None, tenant: str = "") -> str:
    """The target database: the configured one, or the template with {tenant} and {db} put in, or the source's."""
    return spec.target_db or (template.replace("{tenant}", tenant).replace("{db}", spec.db) if template else spec.db)


def authorised(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of enabled tables only. `tables` (db, coll, enabled) comes from a spec, so it is small."""
    return rows.join(F.broadcast(tables.filter("enabled").select("db", "coll").distinct()), ["db", "coll"], "left_semi")


def codec_for(size: int) -> str:
    """Writer codec by size in bytes: none below 1 KiB, lz4 below 100 KiB, zstd above."""
    return "none" if size < 1024 else "lz4" if size < 100 * 1024 else "zstd"


def encoded_bytes(df: DataFrame) -> int:
    """Size of the rows as they would be sent, without a codec: one pass, one number."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0


def write_by_size(df: DataFrame, path: str, codec: str | None = None) -> str:
    """Write Parquet with the codec of the table's measured size, or a configured one."""
    codec = codec or codec_for(encoded_bytes(df))
    df.write.option("compression", codec).parquet(path)
    return codec


def run_tables(spark: SparkSession, specs: list[TableSpec], job: Callable[[TableSpec], int], parallel: int = 4) -> DataFrame:
    """Run one job per table, several at a time; one that fails does not stop the others. Rows: db, coll, status, docs, error."""
    def one(s: TableSpec):
        try:
            return (s.db, s.coll, "completed", int(job(s)), None)
        except Exception as e:  # noqa: BLE001  any failure of a table's job is that table's status
            return (s.db, s.coll, "error", 0, str(e)[:500])

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, specs))
    return spark.createDataFrame(done, "db string, coll string, status string, docs long, error string")


def overall(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("tables"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"),
                      F.when(F.max(F.col("status") == "error"), "error").otherwise("completed").alias("status"))
