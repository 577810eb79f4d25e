"""Applying changes to keyed tables. Every join is an anti join or an equi join on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.changelog import latest
from tidemark.operators.enrich import if_few


def upsert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch replace those with their key, or join the table. Rows without a key are left out (see rejects)."""
    good = batch.filter(F.col(key).isNotNull())
    return target.join(good.select(key), key, "left_anti").select(target.columns).unionByName(good.select(target.columns))


def rejects(batch: DataFrame, key: str) -> DataFrame:
    return batch.filter(F.col(key).isNull())


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti").select(target.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows whose key is new join the table, the others are ignored."""
    return target.unionByName(batch.filter(F.col(key).isNotNull()).join(target.select(key), key, "left_anti").select(target.columns))


def apply_changes(target: DataFrame, changes: DataFrame, key: str = "doc_key") -> DataFrame:
    """Collapse to the last change of each key, then upsert its document or delete. The target has the key and the document's fields."""
    last = latest(changes.filter(F.col("op").isin("insert", "update", "replace", "delete")), [key])
    fields = [c for c in target.columns if c != key]
    kept = last.filter("op <> 'delete'").select(key, *[F.col(f"doc.{c}").alias(c) for c in fields])
    return target.join(last.select(key), key, "left_anti").select(target.columns).unionByName(kept)


def guard(changes: DataFrame, state: DataFrame, on: list[str]) -> DataFrame:
    """Changes past the last sequence applied for their client and table; a table without state passes whole. `state` has a row per client and
    table, and is broadcast if those are few, as counted."""
    s = if_few(state.select(*on, "last_seq"))
    return changes.join(s, on, "left").filter(F.col("seq") > F.coalesce("last_seq", F.lit(-1))).drop("last_seq")


def from_fence(changes: DataFrame, fence) -> DataFrame:
    """Changes at or past the time of the snapshot; overlap does no harm, as keyed replaces can be repeated."""
    return changes.filter(F.col("cluster_time") >= F.lit(fence).cast(changes.schema["cluster_time"].dataType))


def after_drops(changes: DataFrame) -> DataFrame:
    """Changes that outlive the drops in the log: a drop empties its table, dropDatabase all tables of its database, up to its place."""
    place = F.struct("cluster_time", "seq")
    table = changes.filter("op = 'drop'").groupBy("db", "coll").agg(F.max(place).alias("d1"))
    base = changes.filter("op = 'dropDatabase'").groupBy("db").agg(F.max(place).alias("d2"))
    return changes.filter("op NOT IN ('drop', 'dropDatabase')").join(table, ["db", "coll"], "left").join(base, "db", "left").filter(
        (F.col("d1").isNull() | (place > F.col("d1"))) & (F.col("d2").isNull() | (place > F.col("d2")))).select(changes.columns)
