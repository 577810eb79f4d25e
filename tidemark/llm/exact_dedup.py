"""Exact deduplication with salted groups; DataFrame functions only.

Local: Spark's partial aggregation joins equal texts inside each map task, before the shuffle.
Salted: rows meet by (digest, salt, text). A digest with more than `rows_per_salt` rows has as many salts as keep a salted group
near that size, every other digest has one; the limit does not depend on the size of the table. Salts are dealt by the row's place, so rows without
an id, or with one id, are split like any others.
Global: salt winners of the heavy digests meet by (digest, text).
The text is part of every grouping key, so equal digests of different texts never merge.

The list of heavy digests is broadcast only while it is small, as counted. Beyond that the rows meet it by (digest, lane), where the list
stands once in each of several lanes, so that no task gets all rows of a digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, meet


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 2000,
                digest: Callable[[Column], Column] = sha256, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays. A null text counts as empty; a null id is the smallest. Repeated rows with one id
    are members like any others, and `kept` holds for each that has the winning id. Empty input gives an empty result; other
    columns of the input are ignored.
    """
    rows = _from_files(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).withColumn("digest", digest(F.col("text")))
    light, hot = _split(rows, rows_per_salt, broadcast_rows)
    groups = _groups(light)
    member = groups.select("digest", "ids", F.array_max("ids")["id"].alias("keep_id"), F.size("ids").cast("long").alias("group_size"))
    if hot is not None:
        hot = _groups(hot).withColumns({"best": F.array_max("ids")["id"], "n": F.size("ids").cast("long")})
        winners = hot.groupBy("digest", "text").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
        back = hot.join(winners.withColumnsRenamed({"digest": "d", "text": "t"}), (F.col("digest") == F.col("d")) & (F.col("text") == F.col("t")))
        member = member.unionByName(back.select("digest", "ids", "keep_id", "group_size"))
    return member.select("digest", "keep_id", "group_size", F.explode("ids").alias("member")).select(F.col("member.id").alias(id_col), "keep_id", "group_size", "digest").select(
        F.col(id_col), "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def survivors(docs: DataFrame, order: Column, row: Column, text_col: str = "text", rows_per_salt: int = 2000, digest: Callable[[Column], Column] = sha256,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per text: `row` of the member that is last in `order`, and its text. Null counts as empty.

    The same three stages as exact_dedup; members are not listed, so a task holds one of each text that it has seen. The order should tell all rows
    apart that differ; of others any one stays. Nothing is joined back, so rows need no key.
    """
    rows = _from_files(docs.select(order.alias("order"), row.alias("row"), F.col(text_col).alias("raw")))
    rows = rows.withColumn("text", F.coalesce("raw", F.lit(""))).withColumn("digest", digest(F.col("text")))
    last = F.max_by(F.struct("row", F.col("raw").isNull().alias("null")), "order").alias("last")
    light, hot = _split(rows, rows_per_salt, broadcast_rows)
    out = light.groupBy("digest", "salt", "text").agg(last).select("text", "last")
    if hot is not None:
        salted = hot.groupBy("digest", "salt", "text").agg(last, F.max("order").alias("order"))
        out = out.unionByName(salted.groupBy("digest", "text").agg(F.max_by("last", "order").alias("last")).select("text", "last"))
    return out.select("last.row", F.when(~F.col("last.null"), F.col("text")).alias(text_col))


def _from_files(rows: DataFrame) -> DataFrame:
    """The rows, written first if they come out of a shuffle: places of rows count on an order that is the same whenever a task is run again."""
    return cut(rows) if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows


def _split(rows: DataFrame, rows_per_salt: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of light digests (salt 0) and of heavy ones with their salt, None if there are none."""
    per_digest = rows.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_salt)
    heavy = cut(per_digest.select("digest", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("n_salts")))
    if heavy.isEmpty():
        return rows.withColumn("salt", F.lit(0)), None
    place = F.monotonically_increasing_id()
    hot = meet(rows.withColumn("place", place), heavy, ["digest"], "inner", place, broadcast_rows)
    return meet(rows, heavy, ["digest"], "left_anti", place, broadcast_rows).withColumn("salt", F.lit(0)), hot.withColumn("salt", F.pmod("place", "n_salts").cast("int"))


def _groups(rows: DataFrame) -> DataFrame:
    """Rows of one digest, salt and text with their ids; heavy digests have salts enough to bound the lists."""
    return rows.groupBy("digest", "salt", "text").agg(F.collect_list(F.struct("id")).alias("ids"))  # structs, as lists leave out nulls
