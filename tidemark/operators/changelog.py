"""Changelogs: normalising, counting, numbering, deduplicating and collapsing change events.

Schema: db, coll, op, doc_key, doc, cluster_time, seq (and batch_id, event_id, reason where known). Order is (cluster_time, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import counted

DML = ("insert", "update", "replace", "delete")
DDL = ("drop", "rename", "dropDatabase", "createIndexes", "dropIndexes", "modify", "invalidate")
ORDER = F.struct  # position of a change: ORDER("cluster_time", "seq") compares field by field


def normalise(raw: DataFrame, payload: str, doc_schema: str) -> DataFrame:
    """Changelog rows from JSON change events; rows without an op and unknown ops go."""
    schema = f"op string, ns struct<db:string,coll:string>, key bigint, doc {doc_schema}, seq bigint, reason string"
    e = raw.withColumn("e", F.from_json(payload, schema))
    known = F.col("e.op").isin(*DML, *DDL)
    return e.filter(F.coalesce(known, F.lit(False))).select(
        F.col("e.ns.db").alias("db"), F.col("e.ns.coll").alias("coll"), F.col("e.op").alias("op"), F.col("e.key").alias("doc_key"),
        F.when(F.col("e.op").isin("insert", "update", "replace"), F.col("e.doc")).alias("doc"), "cluster_time", F.col("e.seq").alias("seq"), F.col("e.reason").alias("reason"))


def op_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("db", "coll").agg(*[F.count_if(F.col("op") == o).alias(f"n_{o}") for o in (*DML, *DDL)], F.count("*").alias("total"))


def dense(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Add `n`, which numbers the changes of each key from 0 without gaps; a key may hold any share of the rows."""
    return counted(changes, keys, ["cluster_time", "seq"], "n").withColumn("n", F.col("n") - 1)


def sequenced(changes: DataFrame, node: str, batch: int) -> DataFrame:
    """Number the changes of each table from 0, with batch_id and event_id."""
    out = dense(changes, ["db", "coll"])
    return out.withColumns({"batch_id": F.concat_ws("-", F.lit(node), "coll", F.floor(F.col("n") / batch)), "event_id": F.concat_ws("-", F.lit(node), "n", F.unix_micros(F.col("cluster_time").cast("timestamp")))})


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key; combined before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), ORDER("cluster_time", "seq")).alias("r")).select(*keys, "r.*")


def first_within(changes: DataFrame, keys: list[str], ttl_seconds: int, ts: str = "cluster_time") -> DataFrame:
    """Drop a repeat within the time to live of the last sighting that was accepted. Sightings of one event id are few and fit a row."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ttl = ttl_seconds * 1_000_000
    rest = [c for c in changes.columns if c not in keys]
    seen = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.struct(*rest).alias("r"))))
    none = F.filter(F.col("__seen"), lambda x: F.lit(False))
    kept = F.aggregate("__seen", none, lambda acc, x: F.when((F.size(acc) == 0) | (x["at"] - F.element_at(acc, -1)["at"] > ttl), F.concat(acc, F.array(x))).otherwise(acc))
    return changes.groupBy(*keys).agg(seen.alias("__seen")).select(*keys, F.explode(kept).alias("__kept")).select(*keys, "__kept.r.*")


def after(changes: DataFrame, time, seq: int) -> DataFrame:
    """Changes strictly past a position."""
    t = F.lit(time).cast(changes.schema["cluster_time"].dataType)
    return changes.filter((F.col("cluster_time") > t) | (F.col("cluster_time") == t) & (F.col("seq") > seq))


def recent(changes: DataFrame, seconds: int) -> DataFrame:
    """Changes younger than an age, counted from the newest."""
    newest = changes.agg(F.max("cluster_time").alias("__newest"))
    return changes.crossJoin(F.broadcast(newest)).filter(F.col("cluster_time") > F.col("__newest") - F.make_interval(secs=F.lit(seconds))).drop("__newest")


def pending(entries: DataFrame, applied: DataFrame, key: str = "entry_id") -> DataFrame:
    return entries.join(applied.select(key), key, "left_anti")


def byte_rate(size: Column, seconds: float) -> Column:
    return F.sum(size) / F.lit(1024 * 1024 * seconds)
