"""Batches of streams are shared by all tasks; sequences that were applied are looked up without carrying them in rows."""

import random

from pyspark.sql import functions as F

from tidemark.plans import streams
from tidemark.sources.changes import stream
from tidemark.sources.intervals import covered, islands
from tidemark.sources.versioned import Manifest, VersionedTarget
from tidemark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_a_batch_has_rows_in_several_tasks(spark, tmp_path):
    """each batch was one file of one row group, so one task."""
    for source in (streams._in_files(spark, SF, 3), streams._shuffled(spark, SF, 3)):
        seen = []
        J.run(stream(spark, **source), lambda rows, i: seen.append((rows.select(F.input_file_name()).distinct().count(), rows.count())), str(tmp_path / f"c{len(list(tmp_path.iterdir()))}"))
        assert len(seen) == 3 and all(files >= 4 for files, _ in seen) and sum(n for _, n in seen) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_files_that_stay_whole_have_short_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(streams, "ROW_GROUP", 4096)
    paths = spark.read.parquet(streams._in_order(spark, "/root/testdata/sf0.01", 2)).inputFiles()
    assert len(paths) == 2 and all(pq.ParquetFile(p.removeprefix("file://")).num_row_groups > 1 for p in paths)


def test_applied_sequences_are_not_in_the_rows(spark, tmp_path):
    """the intervals of a table stood in each row that was looked up, so the bytes copied grew with the square of the input."""
    t = VersionedTarget(spark, str(tmp_path), "n_key string, client string, coll string, cluster_time timestamp_ntz, seq long", "n_key")
    rows = spark.createDataFrame([("a", "d", "c", x) for x in (*range(-3, 40), None)] + [("b", "d", "c", 7), (None, "d", "c", 1)], "client string, db string, coll string, seq long")
    m = Manifest(applied={'["a", "d", "c"]': [[-2, -1], [4, 4], [10, 19], [30, 35]]})
    left = t._unapplied(m, rows, "client")
    assert "array<" not in left._jdf.queryExecution().optimizedPlan().treeString()
    done = {-2, -1, 4, *range(10, 20), *range(30, 36)}
    assert sorted(r.seq for r in left.filter("client = 'a'").collect()) == [x for x in range(-3, 40) if x not in done]
    assert left.filter("client = 'b' OR client IS NULL").count() == 2


def test_islands_and_lookups_equal_plain_ones(spark):
    rng = random.Random(4)
    numbers = {k: sorted({rng.randrange(-300, 900) for _ in range(n)} | set(range(64, 320)) | {2**40, 2**40 + 1}) for k, n in (("a", 300), ("b", 20), (None, 3))}
    rows = spark.createDataFrame([(k, x) for k, xs in numbers.items() for x in xs for _ in range(1 + x % 2)] + [("a", None)], "k string, x long")
    found = islands(rows, ["k"], "x", 10_000)
    for k, xs in numbers.items():
        plain = []
        for x in xs:
            if plain and plain[-1][1] == x - 1:
                plain[-1][1] = x
            else:
                plain.append([x, x])
        assert [[r.lo, r.hi] for r in found if r.k == k] == plain
    inside = covered([[[r.lo, r.hi] for r in found if r.k == "a"], []])
    asked = spark.createDataFrame([(t, x) for t in (0, 1) for x in range(-310, 910)], "t int, x long")
    assert {r.x for r in asked.filter(inside("t", "x")).collect()} == {x for x in numbers["a"] if x < 910}
