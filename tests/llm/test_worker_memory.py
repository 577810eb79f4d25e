"""What the Python workers of the Jaccard join hold at once, and what they keep for later tasks."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import tidemark.llm.common as common
import tidemark.llm.jaccard_join as J
import tidemark.llm.sentencepiece_codec as C
import tidemark.llm.shingles as S


def batch(n: int = 1000) -> pa.RecordBatch:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(20_000)]
    return pa.RecordBatch.from_pydict({"id": range(n), "text": [" ".join(rng.choices(words, k=330)) for _ in range(n)]})


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        for _ in run([batch()]):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_two_megabytes_takes_no_more_than_a_few_times_that():
    """Sums over all bytes of a slice and its parts took over 100 MB in each worker of an executor."""
    for run in (J._describe(5), J._parts(5, 80, 100), J._sets(5)):
        assert peak_mb(run) < 60


def test_sets_are_the_same_however_many_texts_are_hashed_at_once(monkeypatch):
    texts = [t.encode() for t in batch(40)["text"].to_pylist()] + [b"", b"one two", b" \n", b"a b c d e f a b c d e f"]
    whole = S._sets_at_once(texts, 5)
    for most in (1, 3000, 10**9):
        monkeypatch.setattr(S, "AT_ONCE", most)
        assert all(np.array_equal(a, b) for a, b in zip(S.shingle_sets(texts, 5), whole, strict=True))
    assert [len(x) for x in S.shingle_sets([], 5)] == [0, 0]


def test_ids_are_told_in_the_step_that_reads_the_texts(spark, monkeypatch):
    """Two steps of one task had a Python worker each, so an executor of two cores held four."""
    monkeypatch.setattr(common, "FEW_ROWS", 3)
    rows = spark.range(2000).selectExpr("id", "concat('a b ', id) AS text")
    sets = common.likely(rows, spark.range(0, 2000, 10).toDF("id"), J._sets(3), "id bigint, shingles array<long>")
    assert sets._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert set(range(0, 2000, 10)) <= {r.id for r in sets.collect()}


def test_another_operator_takes_the_memory_of_a_codec():
    common.KEPT.clear()
    C._codecs["a model"] = object()
    list(J._describe(5)(iter([batch(2)])))
    assert not C._codecs
