"""Unit and property tests of the library."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import host_rewrite, human_bytes, object_id_time
from tidemark.functions.predicates import fields, object_id, row_filter
from tidemark.operators import apply as A
from tidemark.operators import changelog as C
from tidemark.operators import snapshot as S
from tidemark.operators.sequence import numbered
from tidemark.plans.spec import SyncSpec, TableSpec, expand
from tidemark.sources.storage import scratch
from tidemark.sources.versioned import VersionedTarget

CHANGE = "db string, coll string, op string, doc_key long, doc struct<value:double>, cluster_time timestamp_ntz, seq long"


def log(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("d", "c", op, k, None if v is None else (v,), t + dt.timedelta(seconds=s), s) for s, (op, k, v) in enumerate(rows)], CHANGE)


def test_templates():
    assert expand("${X:-d}", {}) == "d" and expand("${X:-d}", {"X": ""}) == "d" and expand("${X:-d}/${Y}", {"X": "v", "Y": "w"}) == "v/w" and expand("a${Z}b", {}) == "ab"


def test_spec_loader_takes_a_database_twice():
    text = '{"databases": [{"name": "a", "target": "${T:-b}", "collections": [{"name": "x", "priority": 2}]}, {"name": "a", "priority": -1, "collections": [{"name": "y"}, {"name": "z", "enabled": false}]}]}'
    spec = SyncSpec.load(text, {})
    assert [t.name for t in spec.select()] == ["a.y", "a.x"] and spec.tables[0].target_db == "b"
    assert [t.name for t in spec.select(["a.x"])] == ["a.x"]
    with pytest.raises(ValueError):
        spec.select(["nowhere"])
    with pytest.raises(ValueError):
        spec.select(["a.z"])


def test_routing_names():
    assert S.target_name(TableSpec("a", "c", target_db="t")) == "t" and S.target_name(TableSpec("a", "c"), "{tenant}_{db}", "n1") == "n1_a" and S.target_name(TableSpec("a", "c")) == "a"


def test_slices_and_pages(spark):
    assert [S.n_slices(n) for n in (0, 10_000, 10_001, 25_000, 10**6)] == [1, 1, 1, 2, 50]
    for n, pages in ((1000, 1), (1001, 2)):
        assert S.paged(spark.range(n), "id").select("total_pages").first()[0] == pages
    rows = S.slices(spark.range(25_000).withColumn("id", F.col("id") * 3), "id").groupBy("slice").count().collect()
    assert sorted((r["slice"], r["count"]) for r in rows) == [(0, 12_500), (1, 12_500)]


def test_slices_are_disjoint_and_cover(spark):
    df = spark.range(25_003)
    parts = [df.filter(S.in_slice(F.col("id"), r.low, r.high)).count() for r in S.bounds(df, "id").collect()]
    assert sum(parts) == 25_003 and len(parts) == 2


def test_numbering_with_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 17 == 0 else rng.randint(0, 20)) for i in range(500)]
    got = {r.i: r.rn for r in numbered(spark.createDataFrame(rows, "i long, k long"), F.col("k"), [F.col("i")], slices=7).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}
    assert got == want
    assert numbered(spark.createDataFrame([], "i long, k long"), F.col("k"), [F.col("i")]).count() == 0


@pytest.mark.parametrize("criteria, missing, want", [
    ([{"field": "a", "operator": "eq", "value": None}], "pass", [2]),
    ([{"field": "a", "operator": "NE", "value": 1}], "pass", [2, 3]),
    ([{"field": "a", "operator": "ne", "value": 1}], "reject", [3]),
    ([{"field": "a", "operator": "in", "value": []}], "pass", [1, 2, 3]),
    ([{"field": "a", "operator": "in", "value": []}], "reject", []),
    ([{"field": "a", "operator": "nin", "value": [1]}], "pass", [2, 3]),
    ([{"field": "a", "operator": "lt", "value": 9}], "pass", [1, 3]),
    ([{"field": "s.x", "operator": "regex", "value": "^q"}], "pass", [1]),
    ([{"field": "s.x", "operator": "regex", "value": "("}], "reject", []),
    ([{"field": "gone", "operator": "ne", "value": 1}], "pass", [1, 2, 3]),
    ([{"field": "gone", "operator": "eq", "value": 1}], "pass", []),
    ([{"field": "a", "operator": "gt", "value": "10"}], "reject", [3]),
    ([{"field": "a", "operator": "gte", "value": 1}, {"field": "a", "operator": "lt", "value": 2}], "pass", [1]),
    ([], "pass", [1, 2, 3]), (None, "pass", [1, 2, 3])])
def test_row_filter(spark, criteria, missing, want):
    df = spark.createDataFrame([(1, 1, ("qx",)), (2, None, None), (3, 2, ("xq",))], "id int, a int, s struct<x:string>")
    assert sorted(r.id for r in df.filter(row_filter(df, criteria, missing=missing)).collect()) == want


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = S.snapshot(df, TableSpec("a", "b", criteria=({"field": "v", "operator": "gt", "value": 7},), include=("id",), key="id"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,7)" in plan


def test_fields_and_ids():
    assert fields(["k", "a", "b", "c"], "k", ["a"], ["a"], ["c"]) == ["k", "a", "c"] and fields(["k", "a"], "k", exclude=["k", "a"]) == ["k"] and fields(["k", "a"], "k") == ["k", "a"]
    assert object_id("65a0c0ffee0123456789abcd") and not object_id("65a0")


def test_column_functions(spark):
    urls = ["https://old.host/vcs", "http://x.net", "ftp://x/y", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host_rewrite(F.col("u"), "new.host")).collect()] == ["https://new.host/vcs", "http://new.host", "ftp://x/y", "", None]
    assert [r[0] for r in df.select(host_rewrite(F.col("u"), "")).collect()] == urls
    one = spark.range(1)
    assert one.select(object_id_time(F.lit("65920080aaaaaaaaaaaaaaaa"))).first()[0] == dt.datetime(2024, 1, 1, 0, 0)
    assert [r[0] for r in spark.createDataFrame([(5,), (2048,), (3 * 1024**3,)], "n long").select(human_bytes(F.col("n"))).collect()] == ["5 B", "2.0 KB", "3.0 GB"]


def test_replay_after_a_marker(spark):
    rows = log(spark, [("insert", i, 1.0) for i in range(5)])
    assert sorted(r.seq for r in C.after(rows, "2024-01-01 00:00:02", 2).collect()) == [3, 4]


def test_delete_then_insert_ends_present(spark):
    target = spark.createDataFrame([(1, 0.0)], "doc_key long, value double")
    got = A.apply_changes(target, log(spark, [("delete", 1, None), ("insert", 1, 5.0), ("insert", 2, 1.0), ("delete", 2, None)])).collect()
    assert [tuple(r) for r in got] == [(1, 5.0)]


def test_ttl_counts_from_the_accepted_sighting(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t + dt.timedelta(minutes=m), m) for m in (0, 4, 8, 9, 14)], "k string, cluster_time timestamp_ntz, m int")
    assert sorted(r.m for r in C.first_within(rows, ["k"], 300).collect()) == [0, 8, 14]


def test_drops(spark):
    rows = log(spark, [("insert", 1, 1.0), ("drop", None, None), ("insert", 2, 1.0)])
    assert [r.doc_key for r in A.after_drops(rows).collect()] == [2]


def test_splitting_and_repeating_a_log_changes_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["insert", "update", "replace", "delete"]), rng.randint(0, 8), rng.random()) for _ in range(60)]
    whole = log(spark, rows)
    schema = "doc_key long, cluster_time timestamp_ntz, seq long, value double"
    results = []
    for cuts in ([60], [13, 40, 60]):
        t, before = VersionedTarget(spark, scratch(spark), schema, "doc_key", 3), 0
        for i, c in enumerate(cuts):
            part = whole.filter((F.col("seq") >= before) & (F.col("seq") < c))
            t.apply(part, i, ["value"])
            t.apply(part, i, ["value"])
            t.apply(part, i + 100 if c == 60 else i, ["value"])
            before = c
        results.append(sorted(tuple(r) for r in t.read().select("doc_key", "value").collect()))
    want = {}
    for op, k, v in rows:
        want.pop(k, None) if op == "delete" else want.update({k: v})
    assert results[0] == results[1] == sorted(want.items())


def test_changes_in_files_out_of_order(spark):
    """Key 3 changes only in the later file, with lower sequences; key 2 is deleted in the first one, key 4 is older in the second."""
    rows = [("insert", 2, 1.0), ("insert", 3, 3.0), ("insert", 4, 4.0), ("insert", 1, 1.0), ("delete", 2, None), ("update", 4, 5.0), ("update", 3, 6.0), ("delete", 5, None), ("insert", 1, 9.0)]
    whole = log(spark, rows)
    t = VersionedTarget(spark, scratch(spark), "doc_key long, cluster_time timestamp_ntz, seq long, value double", "doc_key", 3)
    late = F.col("seq").isin(0, 1, 2, 6)
    t.apply(whole.filter(~late), 0, ["value"])
    t.apply(whole.filter(late), 1, ["value"])
    want = [(1, 9.0), (3, 6.0), (4, 5.0)]
    assert sorted(tuple(r) for r in t.read().select("doc_key", "value").collect()) == want
    t.apply(whole, 2, ["value"])
    assert sorted(tuple(r) for r in t.read().select("doc_key", "value").collect()) == want
    t.bootstrap(t.read(), whole.select("db", "coll", "cluster_time", "seq"), 3)
    t.apply(whole, 4, ["value"])
    assert sorted(tuple(r) for r in t.read().select("doc_key", "value").collect()) == want  # the snapshot holds all up to 8


def test_failed_table_stops_no_other(spark):
    def job(t):
        if t.coll == "bad":
            raise RuntimeError("broken")
        return 3

    s = S.run_tables(spark, [TableSpec("a", "bad"), TableSpec("a", "good")], job)
    assert sorted(tuple(r)[1:4] for r in s.collect()) == [("bad", "error", 0), ("good", "completed", 3)]
    assert S.overall(s).first()["status"] == "error"
