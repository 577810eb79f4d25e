"""What the joins of the Jaccard join send to the driver: no table whose rows, as counted, are many, however few bytes its files have."""

from __future__ import annotations

import functools
import random

import pytest

import tidemark.llm.common as common
import tidemark.llm.jaccard_join as J
from tidemark.llm.components import components
from tidemark.llm.jaccard_join import jaccard_components


def most_broadcast(spark, run) -> int:
    """The most rows that a query of run() broadcast."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, queries = 0, store.executionsList()
    for i in range(int(before), queries.size()):
        known, nodes = store.executionMetrics(queries.apply(i).executionId()), store.planGraph(queries.apply(i).executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if m.name() == "number of output rows" and known.contains(m.accumulatorId()):
                        most = max(most, int(known.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_a_list_in_lanes_is_not_broadcast(spark, monkeypatch):
    """Its files are small, so Spark broadcast the list once for each lane: 300,000 parts were 19 million rows, for which a driver of 750 MB had no room."""
    monkeypatch.setattr(common, "FEW_ROWS", 1000)
    listed = common.cut(spark.range(300).selectExpr("xxhash64(id) AS part", "id % 7 AS k"))
    rows = common.cut(spark.range(2000).selectExpr("id", "xxhash64(id % 400) AS part"))
    for how, n in (("inner", 1500), ("left", 2000), ("left_semi", 1500), ("left_anti", 500)):
        got = []
        assert most_broadcast(spark, lambda how=how, got=got: got.extend(common.meet(rows, listed, ["part"], how, broadcast_rows=100).collect())) <= 100
        assert len(got) == n


def test_nodes_of_many_edges_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 20)
    edges = common.cut(spark.range(300).selectExpr("id AS a", "id + 1 AS b").filter("b % 10 > 0").repartition(5))
    rows, got = common.cut(spark.range(300)), []
    assert most_broadcast(spark, lambda: got.extend(rows.join(components(edges).withColumnsRenamed({"component": "c"}), "id", "left").collect())) <= 20
    assert {r.id: r.c for r in got} == {i: i - i % 10 for i in range(300)}


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_no_step_of_the_join_broadcasts_a_table_of_many_rows(spark, monkeypatch, size, num):
    """With the settings of op10 and of the pipeline's near."""
    few = 10
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(J, "meet", functools.partial(common.meet, broadcast_rows=few, lanes=4))
    rng = random.Random(6)
    texts = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(base[: 60 - k % 2] + [f"x{i}y{k}"] * (k % 3)) for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k:k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a // 5 * 5, a):
            if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    got = []
    assert most_broadcast(spark, lambda: got.extend(jaccard_components(df, size=size, num=num).collect())) <= 2 * few  # of few pairs both sides
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and len(set(want)) < len(want)
