"""Alert rules over a stream of metrics: state per rule, database and table, kept in a versioned target, so state and batch commit together.

Rules are read anew for each micro-batch, so the table of rules may change under the stream. A batch's measurements are dealt by alert, sorted by time in the
shuffle, and walked in Arrow batches from one transition to the next; no alert's rows are held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.observe import breaches
from tidemark.sources.intervals import holds
from tidemark.sources.versioned import VersionedTarget
from tidemark.streaming.jobs import run

STATE = "alert string, active boolean, raised long, last long, late long"
STEP = "alert string, at long, said string, value double, active boolean, raised long, last long, late long"
NEVER = -(2**62)


def transitions(active: bool, raised: int, at: np.ndarray, breach: np.ndarray, cooldown: int) -> tuple[list[tuple[int, str]], bool, int]:
    """(index, raised or resolved) in measurements sorted by time, and the state after them: a breach raises an alert that isn't active unless the last
    one was raised less than `cooldown` before; the first measurement in bounds resolves it. Goes from transition to transition, not row by row."""
    found, i = [], 0
    bad, good = np.flatnonzero(breach), np.flatnonzero(~breach)
    while i < len(at):
        if active:
            k = np.searchsorted(good, i)
            if k == len(good):
                break
            i, active = int(good[k]), False
            found.append((i, "resolved"))
        else:
            k = np.searchsorted(bad, max(i, int(np.searchsorted(at, raised + cooldown))))
            if k == len(bad):
                break
            i, active = int(bad[k]), True
            raised = int(at[i])
            found.append((i, "raised"))
        i += 1
    return found, active, raised


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by alert, the alert's state (without a breach) before its measurements."""
    name, active, raised, last, late, new = None, False, NEVER, NEVER, 0, False
    names = [f.split()[0] for f in STEP.split(", ")]
    kinds = pa.schema([("alert", pa.string()), ("at", pa.int64()), ("said", pa.string()), ("value", pa.float64()), ("active", pa.bool_()), ("raised", pa.int64()), ("last", pa.int64()), ("late", pa.int64())])
    for x in batches:
        out = []
        alert = x["alert"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, alert[1:] != alert[:-1])) if len(alert) else np.zeros(0, int)
        for lo, hi in zip(edges, np.append(edges[1:], len(alert)), strict=True):
            if alert[lo] != name:
                if new:
                    out.append((name, None, None, None, active, raised, last, late))
                name, active, raised, last, late, new = alert[lo], False, NEVER, NEVER, 0, False
            if x["active"][lo].as_py() is not None:
                active, raised, last, late = (x[c][lo].as_py() for c in ("active", "raised", "last", "late"))
                lo += 1
            if lo == hi:
                continue
            part = x.slice(lo, hi - lo)
            at, value = part["at"].to_numpy(), part["value"].to_numpy()
            breach = part["breach"].to_numpy(zero_copy_only=False).astype(bool)
            fresh = int(np.searchsorted(at, last)) if not new else 0  # older than what earlier batches held
            late, new = late + fresh, True
            found, active, raised = transitions(active, raised, at[fresh:], breach[fresh:], int(part["cooldown"][0].as_py()))
            out += [(name, int(at[fresh + i]), said, float(value[fresh + i]), None, None, None, None) for i, said in found]
            last = max(last, int(at[-1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names)
    if new:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, None, None, None, active, raised, last, late), kinds.types, strict=True)], names)


class AlertStream:
    """Alerts of the rules over metrics (type, db, coll, at, value and what else rules name). Rules: id, type, op, limit, cooldown (seconds) and, where
    they name one, name, component, db, coll. Below `root` are the state and the transitions of each batch; those of batches that were committed count."""

    def __init__(self, spark: SparkSession, root: str, rules: Callable[[], DataFrame]):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules
        self.state = VersionedTarget(spark, f"{self.root}/state", STATE, "alert")

    def batch(self, metrics: DataFrame, batch: int) -> None:
        if holds(self.state.manifest().batches.get("", []), batch):
            return  # its state is committed, and so are its transitions
        told = breaches(self.rules(), metrics)
        rows = told.select(F.concat_ws("/", "r_id", "db", "coll").alias("alert"), micros(F.col("at")).alias("at"), F.col("value").cast("double").alias("value"), F.coalesce("breach", F.lit(False)).alias("breach"),
                           (F.col("r_cooldown") * 1_000_000).cast("long").alias("cooldown")).filter("at IS NOT NULL")
        both = rows.unionByName(self.state.read(), allowMissingColumns=True)
        steps = both.repartition("alert").sortWithinPartitions("alert", F.col("at").asc_nulls_first(), "value").mapInArrow(_walk, STEP)
        steps.write.parquet(f"{self.root}/steps/batch={batch}", mode="overwrite")
        done = self.spark.read.schema(STEP).parquet(f"{self.root}/steps/batch={batch}")
        self.state.commit(done.filter("said IS NULL").select("alert", "active", "raised", "last", "late"), batch=batch)

    def run(self, metrics: DataFrame, checkpoint: str) -> None:
        run(metrics, self.batch, checkpoint)

    def transitions(self) -> DataFrame:
        """alert (rule/db/coll), at, said, value."""
        done = [b for lo, hi in self.state.manifest().batches.get("", []) for b in range(lo, hi + 1)]
        if not done:
            return self.spark.createDataFrame([], "alert string, at timestamp, said string, value double")
        found = self.spark.read.schema(STEP).parquet(*[f"{self.root}/steps/batch={b}" for b in done]).filter("said IS NOT NULL")
        return found.select("alert", F.timestamp_micros("at").alias("at"), "said", "value")
