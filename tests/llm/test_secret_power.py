"""The secret scan reports single keys, and its decision rule equals a plain one."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets as S


@pytest.fixture(scope="module")
def corpus():
    texts = [t or "" for t, in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()]
    ordinary, tested = Counter(), Counter()
    for t in texts:
        ordinary.update(map(S.cell_of, S.background(t)))
        tested.update(c["cell"] for c in S.candidates(t, S.base_spans(t)))
    return ordinary, tested


@pytest.mark.parametrize("n, times", [(1, 20), (10, 4), (100, 1)])
def test_recall_and_precision_by_number_of_keys(corpus, n, times):
    """Keys of 32 characters and more among 10,000 documents: recall and precision of 0.9, whether one key is there or a hundred, of every alphabet."""
    ordinary, tested = corpus
    p, rng = S.screened(S.p_values(ordinary)), random.Random(n)
    for size in (32, 40, 64):
        for alphabet in S.ENCODINGS[2:]:
            hit = false = 0
            for _ in range(times):
                keys = Counter(S.cell_of("".join(rng.choice(alphabet) for _ in range(size))) for _ in range(n))
                said = S.reported(tested + keys, p, 0.05)
                hit += sum(c for cell, c in keys.items() if said[cell])
                false += sum(c for cell, c in tested.items() if said[cell])
            assert hit >= 0.9 * n * times - (n == 1) and hit >= 9 * false


def test_reports_with_many_identifiers_around(corpus):
    """A hundred identifiers of the texts' own words and one key of each encoding: hardly an identifier is reported."""
    ordinary, tested = corpus
    p, rng = S.screened(S.p_values(ordinary)), random.Random(9)
    names = Counter(rng.choices([c for c, n in ordinary.items()], weights=list(ordinary.values()), k=100))
    keys = Counter(S.cell_of("".join(rng.choice(a) for _ in range(48))) for a in S.ENCODINGS[2:])
    said = S.reported(tested + names + keys, p, 0.05)
    assert sum(n for c, n in keys.items() if said[c]) >= 8 and sum(n for c, n in names.items() if said[c]) <= 2


def plain_rule(values, fdr):
    """Largest k so that the k-th smallest p-value is at most fdr * k / (m * share of true nulls); the p-values up to it."""
    m, best = len(values), -1.0
    if not m:
        return best
    nulls = min(1.0, (1 + sum(v > 0.5 for v in values)) / (0.5 * m))
    for k, v in enumerate(sorted(values), 1):
        if v <= fdr * k / (m * nulls):
            best = v
    return best


def test_the_step_equals_a_plain_one():
    rng = np.random.default_rng(2)
    p = np.sort(rng.random((S.KINDS_OF * S.CLASSES, S.CELLS)), axis=1).ravel() ** 3
    tested = Counter(rng.integers(0, len(p), 800).tolist()) + Counter(rng.integers(0, S.CLASSES * S.CELLS, 50).tolist())
    said = S.reported(tested, p, 0.05)
    for c in range(S.CLASSES):
        cells = [i for i in tested if i // S.CELLS % S.CLASSES == c]
        level = plain_rule([p[i] for i in cells for _ in range(tested[i])], 0.05)
        assert [bool(said[i]) for i in cells] == [p[i] <= level for i in cells]


def test_tail_is_monotone_and_meets_the_counts():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(S.GRID, (rng.normal(12, 2, 4000) ** 2).astype(int)), minlength=S.CELLS).astype(float)
    share = S.tail(counts)
    assert np.all(np.diff(share) >= 0) and share[0] < 1e-4 and share[-1] == 1
    plain = (1 + np.cumsum(counts)) / (1 + counts.sum())
    end = int(np.searchsorted(np.cumsum(counts), S.TAIL))
    assert np.allclose(share[end:], plain[end:]) and abs(share[end - 1] / plain[end] - 1) < 0.9
    assert S.tail(counts / 100).min() == pytest.approx(1 / (1 + counts.sum() / 100), rel=1)


def test_one_key_in_a_table(spark):
    """The whole operator: one random key of 40 characters among the documents is reported, and no other candidate."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    key = "qV7hK2mXw9RtB4nZc6LpY1sD8fGj3vTa5QeUo0Wi"
    one = docs.filter("doc_id = 17").select(F.lit(10**9).alias("doc_id"), F.concat("text", F.lit(f" {key} ")).alias("text"))
    found = S.find_secrets(docs.unionByName(one)).select("doc_id", F.explode(F.filter("spans", lambda s: s["kind"] == "random")).alias("s")).collect()
    assert [r.doc_id for r in found] == [10**9] and found[0].s.p_value < 1e-3
