"""Sync accounting: modes, status, positions, checkpoints, ledgers and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.enrich import if_few


def plan_modes(specs: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Per table: full, clear_full (a stale checkpoint has to go first), resume or incremental."""
    mode = (F.when(F.lit(force), "full").when(F.col("initial_done"), "incremental").when(F.col("status") == "in_progress", "resume")
            .when(F.col("last_key").isNotNull(), "clear_full").otherwise("full"))
    return specs.join(state, ["db", "coll"], "left").withColumn("mode", mode)


def status_rollup(state: DataFrame) -> DataFrame:
    done, bad = F.col("status") == "completed", F.col("status") == "error"
    return state.agg(F.count("*").alias("tables"), F.count_if(done).alias("completed"), F.count_if(bad).alias("failed"), F.count_if(F.col("status") == "in_progress").alias("running"),
                     F.sum("docs_total").alias("docs"), F.when(F.max(bad), "error").when(F.min(done), "completed").otherwise("in_progress").alias("status"))


def reconcile(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Counts on both sides per table, and whether it needs another sync."""
    a = source.groupBy(*keys).agg(F.count("*").alias("n_source"))
    b = target.groupBy(*keys).agg(F.count("*").alias("n_target"))
    both = a.join(b, keys, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_source", "n_target")})
    return both.withColumn("action", F.when(F.col("n_source") == F.col("n_target"), "skip").otherwise("resync"))


def consistency(state: DataFrame, source: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Per state row: whether its last key is still in the source, and whether a completed table has fewer rows than were transferred."""
    counts = source.groupBy(*on).agg(F.count("*").alias("n_now"))
    asked = if_few(state.select(*on, "last_key").distinct())
    keys = source.select(*on, F.col(key).alias("last_key")).join(asked, [*on, "last_key"], "left_semi").distinct().withColumn("found", F.lit(True))
    return state.join(keys, [*on, "last_key"], "left").join(counts, on, "left").select(
        *on, "last_key", F.coalesce("found", F.lit(False)).alias("last_key_found"), F.coalesce("n_now", F.lit(0)).alias("n_now"),
        ((F.col("status") == "completed") & (F.coalesce("n_now", F.lit(0)) < F.col("docs_total"))).alias("shrunk"))


def untransferred(docs: DataFrame, state: DataFrame, created: Column, on: list[str]) -> DataFrame:
    """Rows a client still lacks: no state, state in initial mode, or created after its last update. `state` has a row per client and table."""
    s = if_few(state.select(*on, "mode", "updated_at"))
    return docs.join(s, on, "left").filter(F.col("mode").isNull() | (F.col("mode") == "initial") | (created > F.col("updated_at"))).drop("mode", "updated_at")


def resume_validity(checkpoints: DataFrame, log: DataFrame, time: str = "last_time") -> DataFrame:
    """Whether each position lies in the retained log; the fallback is the oldest entry."""
    span = log.agg(F.min("cluster_time").alias("oldest"), F.max("cluster_time").alias("newest"))
    ok = F.col(time).between(F.col("oldest"), F.col("newest"))
    return checkpoints.crossJoin(F.broadcast(span)).withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("start", F.when(F.col("valid"), F.col(time)).otherwise(F.col("oldest")))


def checkpoint_stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "in_progress").alias("active"), F.count_if(F.col("status") == "error").alias("errors"),
                     F.sum("docs_total").alias("processed"), F.max("updated_at").alias("updated_at"))


def client_stats(clients: DataFrame) -> DataFrame:
    """`clients` has client_id, connected and the array collections."""
    n = F.size("collections").cast("long")
    return clients.agg(F.count_if("connected").alias("connected"), F.count_if(~F.col("connected")).alias("disconnected"), F.sum(n).alias("collections"),
                       F.sum(F.when(F.col("connected"), n).otherwise(0)).alias("active_collections"))


def log_window(log: DataFrame) -> DataFrame:
    """Oldest and newest entry, hours retained, and their class."""
    out = log.agg(F.min("cluster_time").alias("oldest"), F.max("cluster_time").alias("newest"))
    seconds = F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp"))
    out = out.withColumn("hours", F.round(seconds / 3.6e9, 4))
    return out.withColumn("class", F.when(F.col("hours") < 1, "risky").when(F.col("hours") < 6, "caution").otherwise("good"))


def ledger_totals(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """State as the aggregate of an append-only ledger of transfer batches."""
    done = F.col("status") == "completed"
    return ledger.groupBy(*keys).agg(F.count("*").alias("batches"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
                                     F.sum(F.when(done, F.col("docs")).otherwise(0)).alias("docs"), F.max(F.when(done, F.col("end_seq"))).alias("watermark"))


def retain(clients: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Clients that are connected or were seen in the last days."""
    return clients.filter(F.col("connected") | (F.col("last_seen") >= now - F.make_dt_interval(F.lit(days))))
