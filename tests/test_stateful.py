"""Versioned targets (drops, fences, guards, ledger, buckets), segmented scans and alert rules, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments as G
from tidemark.sources.intervals import holds, islands, merged
from tidemark.sources.storage import scratch
from tidemark.sources.versioned import VersionedTarget
from tidemark.streaming.alerting import NEVER, transitions

CHANGE = "client string, db string, coll string, op string, doc_key long, doc struct<value:double>, cluster_time timestamp_ntz, seq long"
TARGET = "doc_key long, cluster_time timestamp_ntz, seq long, value double"
T0 = dt.datetime(2024, 1, 1)
US = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)


def log(spark, rows):
    """Rows (seq, coll, op, key, value); the time is the sequence."""
    return spark.createDataFrame([("c1", "d", c, op, k, None if v is None else (v,), T0 + dt.timedelta(seconds=s), s) for s, c, op, k, v in rows], CHANGE)


def target(spark, **more):
    return VersionedTarget(spark, scratch(spark), TARGET, "doc_key", **more)


def rows_of(t):
    return sorted((r.doc_key, r.value) for r in t.read().collect())


def replayed(rows):
    """A log applied change by change in its order."""
    have = {}
    for _, c, op, k, v in sorted(rows):
        if op == "drop":
            have = {key: x for key, x in have.items() if x[0] != c}
        elif op == "dropDatabase":
            have = {}
        elif op == "delete":
            have.pop(k, None)
        elif op != "rename" and k is not None:
            have[k] = (c, v)
    return sorted((k, v) for k, (_, v) in have.items())


def test_drops_and_changes_in_batches_of_any_order(spark):
    rng = random.Random(4)
    ops = ["insert", "update", "replace", "delete", "insert", "update"]
    rows = []
    for s in range(150):
        op = "dropDatabase" if s == 40 else rng.choice(["drop", "rename"]) if s % 31 == 30 else rng.choice(ops)
        k = None if op in ("drop", "rename", "dropDatabase") or s % 29 == 7 else rng.randrange(20)
        rows.append((s, f"c{(k if k is not None else s) % 2}", op, k, None if op in ("delete", "drop", "rename", "dropDatabase") else float(s)))
    want = replayed(rows)
    for order in range(2):
        mixed = list(rows)
        random.Random(order).shuffle(mixed)
        t = target(spark, rows_per_bucket=10)
        for i in range(3):
            t.apply(log(spark, mixed[i * 50:(i + 1) * 50]), i, ["value"])
        t.apply(log(spark, mixed), 100, ["value"])  # all of it again
        assert rows_of(t) == want
        assert {(r.op, r.seq) for r in t.notes("audit").collect()} == {(op, s) for s, _, op, _, _ in rows if op in ("drop", "rename", "dropDatabase")}
        assert t.notes("reject").agg(F.sum("docs")).first()[0] == 2 * sum(k is None and op in ops for _, _, op, k, _ in rows)


def test_bootstrap_goes_on_after_its_fence(spark):
    """A snapshot at 5 lacks key 1, which was deleted before; changes up to the fence come again, later ones before and after each other."""
    t = target(spark)
    before = [(0, "c1", "insert", 1, 1.0), (1, "c1", "insert", 2, 2.0), (2, "c1", "delete", 1, None), (3, "c1", "insert", 3, 3.0)]
    t.apply(log(spark, before[:2]), 0, ["value"])
    fence = log(spark, [(5, "c1", "update", 2, 5.0)]).select("db", "coll", "cluster_time", "seq")
    snapshot = spark.createDataFrame([("d", "c1", 2, 5.0), ("d", "c1", 3, 3.0), ("d", "c1", None, 0.0)], "db string, coll string, doc_key long, value double")
    assert t.bootstrap(snapshot, fence, 1, "snap", "db", "coll") and not t.bootstrap(snapshot, fence, 1, "snap", "db", "coll")
    assert rows_of(t) == [(2, 5.0), (3, 3.0)] and t.manifest().generation == 1 and t.notes("reject").first().docs == 1
    t.apply(log(spark, [(9, "c1", "update", 3, 9.0), (7, "c1", "insert", 4, 7.0), *before]), 1, ["value"])
    t.apply(log(spark, [(6, "c1", "insert", 1, 6.0), (8, "c1", "delete", 2, None), (4, "c1", "update", 3, 4.0)]), 2, ["value"])
    assert rows_of(t) == [(1, 6.0), (3, 9.0), (4, 7.0)]
    t.apply(log(spark, [(10, "c1", "drop", None, None), (11, "c1", "insert", 8, 8.0)]), 3, ["value"])
    assert rows_of(t) == [(8, 8.0)]  # a drop finds the snapshot's rows too


def test_a_stream_that_starts_before_the_fence_is_an_error(spark):
    t = target(spark)
    t.bootstrap(spark.createDataFrame([], "db string, coll string, doc_key long, value double"), log(spark, [(60, "c1", "insert", 1, 1.0)]).select("db", "coll", "cluster_time", "seq"), 0, "snap", "db", "coll")
    at = US + 60_000_000
    assert t.check_start(at, at) == [] and t.check_start(at + 5, at + 3600 * 10**6) == []
    assert t.check_start(at, at + 3601 * 10**6) == ["fence of d.c1 is 3601 s old"]
    with pytest.raises(ValueError, match="d.c1"):
        t.check_start(at - 1, at)


def test_guard_by_client_and_table(spark):
    t = target(spark)
    t.apply(log(spark, [(0, "c1", "insert", 1, 0.0), (1, "c1", "insert", 2, 1.0), (4, "c1", "insert", 3, 4.0)]), 0, ["value"], "s", "client")
    t.apply(log(spark, [(0, "c2", "insert", 9, 0.0)]), 7, ["value"], "other", "client")  # another table and stream have their own
    state = {(r.coll): (r.acked_seq, r.last_seq, r.gaps) for r in t.positions().collect()}
    assert state == {"c1": (1, 4, 1), "c2": (0, 0, 0)}
    changed = log(spark, [(1, "c1", "insert", 2, -1.0), (3, "c1", "insert", 5, 3.0), (4, "c1", "insert", 3, -4.0)]).withColumn("cluster_time", F.col("cluster_time") + F.expr("INTERVAL 1 DAY"))
    t.apply(changed, 1, ["value"], "s", "client")  # 1 and 4 are replays though they look newer, 3 is late
    assert rows_of(t) == [(1, 0.0), (2, 1.0), (3, 4.0), (5, 3.0), (9, 0.0)]
    t.apply(log(spark, [(2, "c1", "insert", 6, 2.0)]), 2, ["value"], "s", "client")
    assert {(r.coll): (r.acked_seq, r.gaps) for r in t.positions().collect()}["c1"] == (4, 0)
    assert not t.apply(log(spark, [(5, "c1", "insert", 7, 5.0)]), 1, ["value"], "s", "client") and t.manifest().batches == {"s": [[0, 2]], "other": [[7, 7]]}


def test_intervals(spark):
    rng = random.Random(1)
    numbers = rng.sample(range(200), 90)
    got = []
    for i in range(0, 90, 9):
        got = merged(got, [[x, x] for x in numbers[i:i + 9]])
    assert [x for x in range(-2, 203) if holds(got, x)] == sorted(numbers)
    rows = spark.createDataFrame([("a", x) for x in numbers] + [("a", numbers[0]), (None, 3), (None, 4), ("b", None)], "k string, x long")
    found = islands(rows, ["k"], "x", 100)
    assert [[r.lo, r.hi] for r in found if r.k == "a"] == got and [(r.lo, r.hi) for r in found if r.k is None] == [(3, 4)]
    with pytest.raises(ValueError):
        islands(rows, ["k"], "x", 3)


def test_ledger_of_failed_and_orphaned_batches(spark):
    t = target(spark)
    one = log(spark, [(0, "c1", "insert", 1, 0.0), (1, "c1", "insert", 2, 1.0)])
    t.recorded("s", 0, lambda: t.apply(one, 0, ["value"], "s", "client"))
    with pytest.raises(RuntimeError):
        t.recorded("s", 1, lambda: (_ for _ in ()).throw(RuntimeError("no disk")))
    t._log("s", 2, "s-2-x", "in_progress")  # its job was killed
    t._log("s", 3, "s-3-x", "in_progress")
    got = {(r.batch, r.client, r.status, r.docs, r.end_seq, r.message) for r in t.ledger().collect()}
    assert got == {(0, "c1", "completed", 2, 1, None), (1, None, "failed", None, None, "no disk"), (2, None, "orphaned", None, None, None), (3, None, "in_progress", None, None, None)}
    t.recorded("s", 1, lambda: t.apply(one, 1, ["value"], "s", "client"))
    assert {r.status for r in t.ledger().filter("batch = 1").collect()} == {"completed"}


def test_a_small_batch_rewrites_the_buckets_it_touches(spark):
    t = VersionedTarget(spark, scratch(spark), "doc_key long, value double", "doc_key", rows_per_bucket=100)
    t.commit(spark.range(1000).selectExpr("id AS doc_key", "0D AS value"), batch=0)
    first = t.manifest().buckets
    assert 10 <= len(first) <= 32 and all(v == 1 for v, _ in first.values()) and sum(n for _, n in first.values()) == 1000
    t.commit(spark.range(40, 43).selectExpr("id AS doc_key", "1D AS value"), batch=1)
    second = t.manifest().buckets
    assert sum(v == 2 for v, _ in second.values()) <= 3 and sum(n for _, n in second.values()) == 1000
    t.commit(spark.range(1000, 4000).selectExpr("id AS doc_key", "2D AS value"), batch=2)
    third = t.manifest().buckets
    assert len(third) > 2 * len(first) and max(n for _, n in third.values()) <= 200
    assert t.read().agg(F.count("*"), F.sum("value"), F.countDistinct("doc_key")).first()[:] == (4000, 6003.0, 4000)
    t.commit(deletes=spark.range(3500).selectExpr("id AS doc_key"), batch=3)
    assert t.read().count() == 500 and not t.commit(spark.range(1).selectExpr("id AS doc_key", "9D AS value"), batch=2)


def test_old_versions_leave(spark):
    t = target(spark, history=2, rows_per_bucket=3)
    for i in range(6):
        t.apply(log(spark, [(i, "c1", "insert", i, float(i))]), i, ["value"])
    assert len(t.versions()) <= 3 and rows_of(t) == [(i, float(i)) for i in range(6)]


def test_tombstones_are_let_go_once_settled(spark):
    t = target(spark)
    t.apply(log(spark, [(1, "c1", "insert", 1, 1.0), (2, "c1", "delete", 1, None)]), 0, ["value"])
    t.apply(log(spark, [(9, "c1", "insert", 2, 9.0)]), 1, ["value"], settled=US + 5_000_000)
    t.apply(log(spark, [(0, "c1", "insert", 1, 0.0), (7, "c1", "insert", 3, 7.0)]), 2, ["value"])
    assert rows_of(t) == [(2, 9.0), (3, 7.0)]
    assert t._stored(t.manifest(), t.manifest().buckets).filter("_gone").count() == 0


def test_one_hot_key_is_cut_into_parts(spark):
    """All rows have one key; ties in time; every scan equals plain Python, and no part holds more than its share."""
    rng = random.Random(8)
    rows = [("hot", T0 + dt.timedelta(seconds=rng.randrange(400)), i, float(rng.randrange(1000)) / 4) for i in range(2000)] + [(None, T0, 5000, 1.0), ("cold", T0, 5001, 2.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, v double").repartition(5)
    s = G.Segments(df, ["k"], ["ts", "seq"], 8)
    assert max(r["count"] for r in s.rows.groupBy(G.PART).count().collect()) < 2002 / 8 * 2.5 and len(s.chains) == 1
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
    got = {r.seq: r.n for r in G.counted(df, ["k"], ["ts", "seq"], "n", 8).collect()}
    assert got == {r[2]: i for own in by.values() for i, r in enumerate(own, 1)}
    for r in G.moments_before(df, ["k"], ["ts", "seq"], "v", 8).collect():
        own = by[r.k]
        before = np.array([x[3] for x in own[:next(i for i, x in enumerate(own) if x[2] == r.seq)]])
        assert r.n == len(before) and (r.mean is None) == (len(before) == 0)
        if len(before):
            assert abs(r.mean - before.mean()) < 1e-9 and abs(r.sd - before.std()) < 1e-9
    for r in G.trailing(df, ["k"], "ts", F.col("v"), 30_000_000, "sum", parts=8).collect():
        assert float(r["sum"]) == sum(x[3] for x in by[r.k] if r.ts - dt.timedelta(seconds=30) <= x[1] <= r.ts)
    last = s.clean(s.with_last(2).withColumn("sum3", F.sum("v").over(s.window.rowsBetween(-2, 0))))
    assert {r.seq: r.sum3 for r in last.collect()} == {x[2]: sum(y[3] for y in own[max(0, i - 2):i + 1]) for own in by.values() for i, x in enumerate(own)}


def step(active, raised, now, breach, cooldown):
    if breach and not active and now - raised >= cooldown:
        return True, now, "raised"
    return (False, raised, "resolved") if active and not breach else (active, raised, None)


def test_transitions_equal_the_fold():
    rng = np.random.default_rng(3)
    for cooldown in (0, 5, 60):
        at, breach = np.sort(rng.integers(0, 500, 400)), rng.random(400) < 0.4
        active, raised, want = False, NEVER, []
        for i, (t, b) in enumerate(zip(at, breach, strict=True)):
            active, raised, said = step(active, raised, int(t), bool(b), cooldown)
            want += [(i, said)] if said else []
        got, a, r = [], False, NEVER
        for lo in range(0, 400, 37):  # in pieces, with the state carried on
            found, a, r = transitions(a, r, at[lo:lo + 37], breach[lo:lo + 37], cooldown)
            got += [(lo + i, said) for i, said in found]
        assert got == want and (a, r) == (active, raised)
