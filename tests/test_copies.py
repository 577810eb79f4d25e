"""Keyset pages, time partitions, fan-out, codecs by size and alert streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.predicates import row_filter
from tidemark.operators import snapshot as S
from tidemark.operators.pages import CountMismatch, KeysetPages
from tidemark.operators.patterns import joined
from tidemark.sources.partitions import FanOut, TimePartitions
from tidemark.sources.storage import scratch
from tidemark.streaming.alerting import AlertStream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 2000, 2).select("id", F.col("id").cast("string").alias("name")).unionByName(spark.range(3).select(F.lit(500).cast("long").alias("id"), F.lit("tie").alias("name"))).unionByName(
        spark.createDataFrame([(None, "null")], "id long, name string")).write.parquet(path)
    return spark.read.parquet(path)


def test_pages_stop_and_resume(spark, table):
    seen, progress = {}, scratch(spark)

    def sink(rows, page):
        if page == 3 and 3 not in seen:
            seen[3] = None
            raise TimeoutError
        got = [r.id for r in rows.collect()]
        assert got == sorted(got)
        seen[page] = got
        return len(got)

    with pytest.raises(TimeoutError):
        KeysetPages(table, "id", 120, progress, 99).push(sink)
    assert KeysetPages(table, "id", 120, progress, 99).progress().page == 2
    assert KeysetPages(table, "id", 120, progress, 99).push(sink) == 953
    pages = [seen[k] for k in sorted(seen)]
    assert sum(pages, []) == sorted([*range(100, 2000, 2), 500, 500, 500]) and 7 <= len(pages) <= 10 and max(map(len, pages)) <= 130
    assert KeysetPages(table, "id", 120, progress, 99).push(sink) == 953  # nothing is left


def test_pages_reach_the_scan_and_count(spark, table):
    _, rows = next(KeysetPages(table, "id", 100, scratch(spark)).pages(200))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,200)" in plan and "LessThanOrEqual(id," in plan
    with pytest.raises(CountMismatch):
        KeysetPages(table, "id", 400, scratch(spark)).push(lambda rows, page: rows.count() - 1)
    names = []
    assert KeysetPages(table.filter("id < 40"), "name", 8, scratch(spark)).push(lambda rows, page: names.extend(r.name for r in rows.collect()) or rows.count()) == 20
    assert names == sorted(str(i) for i in range(0, 40, 2))
    assert KeysetPages(table.limit(0), "id", 8, scratch(spark)).push(lambda rows, page: 1) == 0


def test_old_partitions_leave_whole(spark):
    t = TimePartitions(spark, scratch(spark), "id long, ts timestamp_ntz", "ts")
    rows = spark.range(50).select("id", (F.lit(T0).cast("timestamp_ntz") + F.make_interval(hours=F.col("id"))).alias("ts")).unionByName(spark.createDataFrame([(99, None)], "id long, ts timestamp_ntz"))
    t.append(rows, 0)
    t.append(rows, 0)  # the batch again
    assert t.read().count() == 51 and len(t.parts()) == 51
    limit = F.lit(T0 + dt.timedelta(hours=40, minutes=30)).cast("timestamp_ntz")
    assert len(t.expire(limit)) == 40 and t.expire(limit) == []
    assert sorted(r.id for r in t.read(limit).collect()) == [*range(41, 50), 99] and sorted(r.id for r in t.read().collect()) == [*range(40, 50), 99]
    t.append(rows.filter("id = 45"))
    assert t.read().filter("id = 45").count() == 2


def test_a_fanned_batch_is_seen_by_all_sinks_or_none(spark, monkeypatch):
    f = FanOut(spark, scratch(spark), "id long", 3, "round_robin", "id")
    assert f.read().count() == 0
    f.batch(spark.range(30), 0)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            f.batch(spark.createDataFrame([(7,)], "id long"), 1)  # written, not committed
    assert [f.read(k).count() for k in range(3)] == [10, 10, 10]
    f.batch(spark.range(30, 36), 1)
    assert f.read().count() == 36 and {r.id % 3 for r in f.read(1).collect()} == {1}
    with pytest.raises(ValueError):
        FanOut(spark, "x", "id long", 2, "random")


def test_codec_by_measured_size(spark, tmp_path):
    assert [S.codec_for(n) for n in (0, 1023, 1024, 102_399, 102_400)] == ["none", "none", "lz4", "lz4", "zstd"]
    rows = spark.range(100)
    assert S.encoded_bytes(rows) == sum(len(f'{{"id":{i}}}') for i in range(100)) and S.encoded_bytes(rows.limit(0)) == 0
    assert S.write_by_size(rows, str(tmp_path / "a")) == "none" and S.write_by_size(rows, str(tmp_path / "b"), "zstd") == "zstd"


def test_ids_by_their_digits(spark):
    df = spark.createDataFrame([(1, bytes.fromhex("00" * 11 + "0a")), (2, bytes.fromhex("00" * 11 + "0b")), (3, None)], "n int, _id binary")
    keep = lambda op, v: sorted(r.n for r in df.filter(row_filter(df, [{"field": "_id", "operator": op, "value": v}])).collect())
    assert keep("eq", "0" * 23 + "A") == [1] and keep("in", ["0" * 23 + "a", "0" * 23 + "b"]) == [1, 2] and keep("ne", "0" * 23 + "a") == [2, 3]


def test_patterns_join_by_chains(spark):
    pairs = spark.createDataFrame([("b", "c"), ("c", "d"), ("a", "d"), ("x", "y")], "a string, b string")
    assert {r.bucket: r.pattern for r in joined(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_alert_stream_with_late_rows_and_changed_rules(spark):
    rules = [("r", "m", "gt", 10.0, 100)]
    alerts = AlertStream(spark, scratch(spark), lambda: spark.createDataFrame(rules, "id string, type string, op string, limit double, cooldown long"))
    at = lambda s: T0 + dt.timedelta(seconds=s)
    metrics = lambda rows: spark.createDataFrame([("m", "d", c, at(s), v) for s, c, v in rows], "type string, db string, coll string, at timestamp_ntz, value double")
    first = metrics([(30, "a", 1.0), (0, "a", 50.0), (40, "a", 60.0), (5, "b", 1.0)])
    alerts.batch(first, 0)
    alerts.batch(first, 0)  # repeated: the state was committed, so nothing changes
    alerts.batch(metrics([(20, "a", 99.0), (99, "a", 70.0), (100, "a", 70.0), (6, "b", 11.0)]), 1)  # 20 is late
    rules[0] = ("r", "m", "gt", 90.0, 100)
    alerts.batch(metrics([(101, "a", 70.0), (300, "a", 95.0), (7, "b", 50.0)]), 2)
    said = sorted((r.alert, int((r.at - at(0)).total_seconds()), r.said, r.value) for r in alerts.transitions().withColumn("at", F.col("at").cast("timestamp_ntz")).collect())
    assert said == [("r/d/a", 0, "raised", 50.0), ("r/d/a", 30, "resolved", 1.0), ("r/d/a", 100, "raised", 70.0), ("r/d/a", 101, "resolved", 70.0), ("r/d/a", 300, "raised", 95.0), ("r/d/b", 6, "raised", 11.0), ("r/d/b", 7, "resolved", 50.0)]
    assert {r.alert: r.late for r in alerts.state.read().collect()} == {"r/d/a": 1, "r/d/b": 0}
