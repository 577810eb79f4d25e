"""What the Jaccard join has on disk at once: shuffle files of steps that ended, and the sets of clusters."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pandas as pd

import tidemark.llm.common as common
import tidemark.llm.jaccard_join as J
from tidemark.llm.components import components


def shuffled(spark) -> set[Path]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, while later steps shuffled more."""
    before, was = shuffled(spark), spark.conf.get(common.FREED, None)
    df = spark.range(10_000).groupBy("id").count().repartition(3, "count")
    rows, _ = common.written(df)
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert rows.count() == df.count() == 10_000 and spark.conf.get(common.FREED, None) == was


def test_a_family_that_meets_in_many_places_is_one_cluster():
    """Each place named its cluster by all its ids, so a set moved once for each place where its family met."""
    def place(ids: list[int]) -> pd.DataFrame:
        k = len(ids)
        return pd.DataFrame({"id": ids, "n": [50] * k, "point": [np.full(J.GROUPS, 1, np.uint8).tobytes()] * k, "comp": ids, "block": [0] * k, "fine": [np.full(J.FINE, 1, np.uint8).tobytes()] * k})

    found = pd.concat([J._join_place(80, 100)(place([0, *range(k, 60)])) for k in range(1, 20)]).drop_duplicates()
    assert found["cluster"].nunique() == 1 and len(found) == 60


def test_slices_hold_no_more_than_a_share():
    assert J.slices_within({0: 5, 3: 5, 7: 5, 9: 1}, 11) == [0, 3]
    assert J.slices_within({4: 50, 5: 1}, 11) == [4]  # one at least
    assert J.slices_within({1: 2, 0: 1}, 11) == [0, 1]


def test_clusters_in_slices_and_chunks_have_the_links_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [[f"b{b}w{i}" for i in range(60)] for b in range(5)]
    texts = [" ".join(w if rng.random() > 0.012 * (i % 4) else f"x{rng.randrange(10**6)}" for w in base[i % 5]) for i in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [{tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    points = common.cut(rows.select("id").join(spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "id long, n long"), "id"))
    # three clusters that overlap: all, those from 10 on, the even ones; the first ten are known to be one component
    ids = [(c, i) for c, some in enumerate((range(80), range(10, 80), range(0, 80, 2)), 1) for i in some]
    many = spark.createDataFrame([(c, i, 0 if i % 5 == 0 and i < 30 else i) for c, i in ids], "cluster long, id long, comp long")
    taken = []
    within = J.slices_within
    monkeypatch.setattr(J, "slices_within", lambda volume, most: taken.append(within(volume, most)) or taken[-1])
    monkeypatch.setattr(J, "HEAVY", 3000)
    links = J.Join(rows, points, 3, 80, 100).clusters(many, points)
    got = [(r.a, r.b) for r in links.collect()]
    linked = lambda a, b: 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b]))
    assert len(taken) > 1 and got and all(linked(a, b) for a, b in got)

    def groups(edges) -> dict[int, int]:
        label = list(range(80))
        for a, b in edges:
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
        return dict(enumerate(label))

    known = [(0, i) for i in range(0, 30, 5)]
    want = groups([(a, b) for a in range(80) for b in range(a + 1, 80) if linked(a, b)] + known)
    assert 5 < len(set(want.values())) and groups(got + known) == want
    assert {r.id for r in components(links).collect()} <= set(want)
