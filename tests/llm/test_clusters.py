"""Clusters of open places, contracted edges and bounded broadcasts of the Jaccard join."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

import tidemark.llm.common as common
import tidemark.llm.jaccard_join as J
from tidemark.llm.components import _forest, components
from tidemark.llm.jaccard_join import jaccard_components


def test_an_open_place_returns_no_more_rows_than_sets(monkeypatch):
    """All pairs of 300 sets pass the bound; the place used to return 44,850 of them."""
    n = 300
    place = pd.DataFrame({"id": range(n), "n": [50] * n, "point": [np.full(J.GROUPS, 1, np.uint8).tobytes()] * n, "comp": range(n), "block": [0] * n, "fine": [np.full(J.FINE, 1, np.uint8).tobytes()] * n})
    got = J._join_place(90, 100)(place)
    assert len(got) == n and got["cluster"].nunique() == 1 and set(got["a"]) == set(range(n))
    assert set(J._join_place(90, 100)(place.sample(frac=1, random_state=1))["cluster"]) == set(got["cluster"])  # whatever the order
    monkeypatch.setattr(J, "HEAVY", 50 * 100)
    chunks = J._join_place(90, 100)(place).groupby("cluster")["a"].agg(set).tolist()
    assert max(map(len, chunks)) <= 102 and all(any({a, b} <= c for c in chunks) for a in range(0, n, 7) for b in range(n) if a != b)


def test_links_of_a_cluster_are_exact_and_few():
    rng = random.Random(4)
    base = [rng.sample(range(10**6), 40) for _ in range(6)]
    sets = [sorted(set(base[i % 6][: 40 - i % 4] + [10**7 + i] * (i % 3 > 0))) for i in range(120)]
    got = J._join_cluster(90, 100)(pd.DataFrame({"cluster": 1, "id": range(120), "comp": range(120), "shingles": [np.array(s) for s in sets]}))
    linked = lambda i, j: 190 * len(set(sets[i]) & set(sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))
    assert len(got) < 120 and all(linked(i, j) for i, j in got.itertuples(index=False))

    def groups(edges):
        label = list(range(120))
        for i, j in edges:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
        return label

    assert groups(got.itertuples(index=False)) == groups((i, j) for i in range(120) for j in range(i) if linked(i, j))


def test_edges_are_contracted_within_a_task():
    import pyarrow as pa

    rng = random.Random(5)
    edges = [tuple(sorted((rng.randrange(50), rng.randrange(50)), reverse=True)) for _ in range(5000)]
    out = pa.Table.from_batches(_forest(pa.RecordBatch.from_pydict({"u": [u for u, _ in edges[i:i + 500]], "v": [v for _, v in edges[i:i + 500]]}) for i in range(0, 5000, 500)))
    assert out.num_rows == 49 and set(out["v"].to_pylist()) == {0}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(400)], "a string, b string").repartition(7)
    assert {(r.id, r.component) for r in components(edges).collect()} == {(f"n{i:04}", "n0000") for i in range(401)}


def test_ids_beyond_the_broadcast_are_told_by_a_table_of_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 3)
    rows = spark.range(20_000).selectExpr("id", "string(id) AS text")
    got = {r.id for r in common.likely(rows, spark.range(0, 20_000, 100).toDF("id")).collect()}
    assert set(range(0, 20_000, 100)) <= got and len(got) < 400
    texts = [" ".join(f"w{random.Random(i // 2).randrange(10**6)}x{j}" for j in range(60)) + f" end{i % 2}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(df).collect()} == {i: i - i % 2 for i in range(40)}
