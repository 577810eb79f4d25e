"""Closed intervals of whole numbers: what has been applied, with the gaps that late batches may still fill."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Intervals = list[list[int]]


def merged(a: Intervals, b: Intervals) -> Intervals:
    """Both together; neighbours join."""
    out: Intervals = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def holds(intervals: Intervals, x: int) -> bool:
    i = bisect_right(intervals, x, key=lambda iv: iv[0]) - 1
    return i >= 0 and x <= intervals[i][1]


def covered(tables: list[Intervals]) -> Callable[[Column, Column], Column]:
    """A column function of (place in `tables`, number): whether that table's intervals hold the number, by binary search. The intervals are broadcast
    once and never stand in a row, so a number costs the logarithm of their count."""
    lows, highs = ([np.array([iv[side] for iv in t], np.int64) for t in tables] for side in (0, 1))

    @F.arrow_udf("boolean")
    def inside(at: pa.Array, number: pa.Array) -> pa.Array:
        t, x = at.fill_null(-1).to_numpy(zero_copy_only=False), number.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(t), bool)
        for k in np.unique(t[t >= 0]):
            rows = np.flatnonzero(t == k)
            i = np.searchsorted(lows[k], x[rows], "right") - 1
            rows, i = rows[i >= 0], i[i >= 0]
            out[rows] = x[rows] <= highs[k][i]
        return pa.array(out, mask=number.is_null().to_numpy(zero_copy_only=False))

    return inside


def _runs(words: DataFrame, keys: list[str], edge: str, whole: int, side: int) -> DataFrame:
    """Numbers whose bits are set in `edge`; most words have just one, at `whole`."""
    bits = F.expr(f"CASE WHEN {edge} = shiftleft(1L, {whole}) THEN array({whole}) ELSE filter(sequence(0, 63), i -> shiftright({edge}, i) & 1 = 1) END")
    return words.select(*keys, F.explode(bits).alias("bit"), "w").select(*keys, (F.col("w") * 64 + F.col("bit")).alias("x"), F.lit(side).alias("side"))


def islands(rows: DataFrame, keys: list[str], number: str, most: int) -> list[Row]:
    """Runs of consecutive numbers (keys, lo, hi) of each key. Each 64 numbers become one bitmap before anything is shuffled, which splits a hot key; its
    runs' ends meet those of the next bitmap in a join, and only the ends that are left are gathered: more than `most` are an error."""
    x = rows.filter(F.col(number).isNotNull()).select(*keys, F.col(number).cast("long").alias("x"))
    words = x.groupBy(*keys, F.shiftright("x", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(x & 63)))").alias("b"))
    words = words.select(*keys, "w", F.expr("b & ~shiftleft(b, 1)").alias("first"), F.expr("b & ~shiftrightunsigned(b, 1)").alias("last")).persist()
    try:
        lows, highs = _runs(words, keys, "first", 0, 0), _runs(words, keys, "last", 63, 1)
        beside = lambda step: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.x") == F.col("b.x") + step]
        starts, ends = lows.alias("a").join(highs.alias("b"), beside(1), "left_anti"), highs.alias("a").join(lows.alias("b"), beside(-1), "left_anti")
        found = starts.unionByName(ends).limit(2 * most + 1).collect()
    finally:
        words.unpersist()
    if len(found) > 2 * most:
        raise ValueError("numbers are not dense: number them first")
    found.sort(key=lambda r: ([(r[k] is not None, str(r[k])) for k in keys], r["x"], r["side"]))
    return [Row(**{k: a[k] for k in keys}, lo=a["x"], hi=b["x"]) for a, b in zip(found[::2], found[1::2], strict=True)]
