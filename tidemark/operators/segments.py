"""Ordered scans that don't need a key's rows in one task.

Rows are sorted by key and order and cut into parts of about equal size by a range shuffle, wherever a key begins or ends; the parts are written, so a
part is the same in every later job. A window runs inside each part. What a key's earlier parts hold comes in two small forms: a summary (count,
sum, moments) that is combined in the order of the parts, or the last few rows. Only the key at the end of a part can go on in the next one, so there is
at most one summary a part, however many keys or rows there are.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.sources.storage import scratch

PART, BEFORE, ALL = "__part", "__before", "__all"
Summary = dict[str, object]


class Segments:
    """Rows by part. `order` should have no ties within a key, as far as their rows differ."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        spark, to = rows.sparkSession, scratch(rows.sparkSession)
        if not keys:
            rows, keys = rows.withColumn(ALL, F.lit(0)), [ALL]
        self.spark, self.keys, self.order = spark, keys, order
        n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        cut = rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id())
        cut.write.parquet(to)
        self.rows = spark.read.schema(cut.schema).parquet(to)
        self.window = W.partitionBy(PART, *keys).orderBy(*order)
        self.chains = self._chains()

    def _chains(self) -> list[list[int]]:
        """Parts, in their order, over which one key extends: from the first and last key of each part."""
        key = F.struct(*self.keys)
        ends = sorted(tuple(r) for r in self.rows.groupBy(PART).agg(F.min(key), F.max(key)).collect())
        self.first, self.last = {p: low for p, low, _ in ends}, {p: high for p, _, high in ends}
        chains: list[list[int]] = []
        for (p, low, high), (q, after, _) in zip(ends, ends[1:], strict=False):
            if high != after:
                continue
            if chains and chains[-1][-1] == p and low == high:  # p holds this key alone
                chains[-1].append(q)
            else:
                chains.append([p, q])
        return chains

    def _tails(self) -> DataFrame:
        """Rows of the keys that go on beyond their part."""
        pairs = [(p, *self.last[p]) for c in self.chains for p in c[:-1]]
        kinds = self.rows.select(PART, *self.keys).schema
        listed = F.broadcast(self.spark.createDataFrame(pairs, kinds).toDF("__p", *[f"__k{i}" for i in range(len(self.keys))]))  # a row a part
        on = F.col(PART) == F.col("__p")
        for i, k in enumerate(self.keys):
            on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return self.rows.join(listed, on, "left_semi")

    def carried(self, summary: dict[str, Column], combine: Callable[[Summary | None, Summary], Summary], names: dict[str, str]) -> DataFrame:
        """Rows with what the earlier parts of their key come to, as columns `names` (name: type); null where there are none."""
        found = {r[PART]: r.asDict() for r in self._tails().groupBy(PART).agg(*[c.alias(n) for n, c in summary.items()]).collect()} if self.chains else {}
        out = []
        for chain in self.chains:
            acc = None
            for p, q in zip(chain, chain[1:], strict=False):
                acc = combine(acc, found[p])
                out.append((q, *self.first[q], *[acc[n] for n in names]))
        fields = ", ".join(f"__k{i} {self.rows.schema[k].dataType.simpleString()}" for i, k in enumerate(self.keys))
        known = F.broadcast(self.spark.createDataFrame(out, f"__p int, {fields}, " + ", ".join(f"{n} {t}" for n, t in names.items())))
        on = F.col(PART) == F.col("__p")
        for i, k in enumerate(self.keys):
            on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return self.rows.join(known, on, "left").drop("__p", *[f"__k{i}" for i in range(len(self.keys))])

    def with_last(self, k: int) -> DataFrame:
        """Rows, and before those of each part the last `k` rows that its first key has in earlier parts, marked BEFORE."""
        rows = self.rows.withColumn(BEFORE, F.lit(False))
        if not self.chains:
            return rows
        last = W.partitionBy(PART).orderBy(*[F.desc(o) for o in self.order])
        found: dict[int, list[Row]] = {}
        for r in self._tails().withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= k).orderBy(PART, F.desc("__n")).drop("__n").collect():  # k rows a part
            found.setdefault(r[PART], []).append(r)
        out = []
        for chain in self.chains:
            seen: list[Row] = []
            for p, q in zip(chain, chain[1:], strict=False):
                seen = (seen + found[p])[-k:]
                out += [(*[r[c] for c in self.rows.columns if c != PART], q, True) for r in seen]
        names = [c for c in self.rows.columns if c != PART]
        return rows.unionByName(self.spark.createDataFrame(out, rows.select(*names, PART, BEFORE).schema))

    def clean(self, rows: DataFrame) -> DataFrame:
        """Without the rows of with_last() and the columns of the scan."""
        rows = rows.filter(~F.col(BEFORE)) if BEFORE in rows.columns else rows
        return rows.drop(PART, BEFORE, ALL)


def counted(rows: DataFrame, keys: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Number the rows of each key from 1."""
    s = Segments(rows, keys, order, parts)
    x = s.carried({"n": F.count("*")}, lambda acc, r: {"__carry": (acc or {"__carry": 0})["__carry"] + r["n"]}, {"__carry": "long"})
    return s.clean(x.withColumn(out, F.row_number().over(s.window) + F.coalesce("__carry", F.lit(0).cast("long"))).drop("__carry"))


def moments_before(rows: DataFrame, keys: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Add n, mean and sd (population) of all earlier values of the key."""
    s = Segments(rows, keys, order, parts)
    x = s.carried({"n": F.count(value), "mean": F.avg(value), "m2": F.var_pop(value) * F.count(value)}, _together, {"__n": "long", "__mean": "double", "__m2": "double"})
    w = s.window.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({"__ln": F.count(value).over(w), "__lmean": F.coalesce(F.avg(value).over(w), F.lit(0.0)), "__lm2": F.coalesce(F.var_pop(value).over(w), F.lit(0.0)) * F.count(value).over(w)})
    cn, cm, c2 = (F.coalesce(c, F.lit(0).cast(t)) for c, t in (("__n", "long"), ("__mean", "double"), ("__m2", "double")))
    n, apart = cn + F.col("__ln"), F.col("__lmean") - cm
    some = n > 0
    mean = F.when(some, F.when(cn == 0, F.col("__lmean")).otherwise(cm + apart * F.col("__ln") / n))
    m2 = F.when(cn == 0, F.col("__lm2")).otherwise(c2 + F.col("__lm2") + apart * apart * cn * F.col("__ln") / n)
    x = x.withColumns({"n": n, "mean": mean, "sd": F.when(some, F.sqrt(m2 / n))})
    return s.clean(x.drop("__n", "__mean", "__m2", "__ln", "__lmean", "__lm2"))


def _together(acc: Summary | None, r: Summary) -> Summary:
    """Count, mean and squared distances of two stretches of values as one."""
    n, mean, m2 = r["n"], r["mean"] or 0.0, r["m2"] or 0.0
    if acc is None or not acc["__n"]:
        return {"__n": n, "__mean": mean, "__m2": m2}
    if not n:
        return acc
    total, apart = acc["__n"] + n, mean - acc["__mean"]
    return {"__n": total, "__mean": acc["__mean"] + apart * n / total, "__m2": acc["__m2"] + m2 + apart * apart * acc["__n"] * n / total}


def trailing(rows: DataFrame, keys: list[str], ts: str, value: Column, span_micros: int, out: str, kind: str = "decimal(38,2)", parts: int | None = None) -> DataFrame:
    """Sum of an exact value over the rows of the key from `span_micros` before each row up to it, those of the same time included.

    It is the running sum at the row less that before the span: rows of one time are added up first, and a mark for the beginning of each span runs along
    with them, so a span may be as long as the table and no task needs its rows together.
    """
    at = rows.withColumn("__t", micros(F.col(ts)))
    per = at.groupBy(*keys, "__t").agg(F.sum(value.cast(kind)).cast(kind).alias("__v"))
    marks = per.select(*keys, F.explode(F.array(F.struct(F.col("__t").alias("at"), F.lit(1).alias("real"), F.col("__v").alias("v")),
                                                F.struct((F.col("__t") - span_micros).alias("at"), F.lit(0).alias("real"), F.lit(0).cast(kind).alias("v")))).alias("m"), "__t").select(*keys, "m.*", "__t")
    s = Segments(marks, keys, ["at", "real", "__t"], parts)
    zero = F.lit(0).cast(kind)
    x = s.carried({"v": F.sum("v").cast(kind)}, lambda acc, r: {"__sum": (acc["__sum"] if acc else Decimal(0)) + (r["v"] or 0)}, {"__sum": kind})
    so_far = F.coalesce(F.sum("v").over(s.window.rowsBetween(W.unboundedPreceding, 0)), zero) + F.coalesce("__sum", zero)
    x = x.withColumn("__so", F.when(F.col("real") == 1, so_far).otherwise(-so_far).cast(kind))
    sums = x.groupBy(*keys, "__t").agg(F.sum("__so").cast(kind).alias(out))
    same = [at[k].eqNullSafe(sums[k]) for k in keys] + [at["__t"].eqNullSafe(sums["__t"])]
    on = same[0]
    for c in same[1:]:
        on &= c
    return at.join(sums, on).select(*[at[c] for c in rows.columns], out)
