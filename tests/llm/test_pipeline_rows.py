"""Stages of the pipeline keep whole rows whatever happens between planning and writing, and whatever columns a table has."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as X

DATA = "/root/testdata/sf0.001"
CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", ["exact", "near"])
def test_rows_stay_theirs_when_cores_change(spark, pipeline, tmp_path, name):
    path = str(tmp_path / "docs")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)).repartition(6).write.parquet(path)
    small = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(small)
    got = []
    try:
        spark.conf.set(small, "100k")
        for first, second in ((4, 4), (4, 2)):
            spark.conf.set(CORES, first)
            out = dict(pipeline.STAGES)[name](spark, spark.read.parquet(path), DATA)
            spark.conf.set(CORES, second)
            got.append(sorted((r.doc_id, r.text) for r in out.collect()))
    finally:
        spark.conf.unset(CORES)
        spark.conf.set(small, before)
    assert got[0] == got[1] and len(got[0]) > 100


def test_columns_of_any_name_and_kind(spark, pipeline):
    names = ("_row", "_tie", "row", "tie", "key", "id", "order", "digest", "salt", "last", "raw", "place", "component_id", "n", "keep_id")
    text = " ".join(f"word{i} is here" for i in range(60))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " more", "en", None, None), (4, "a quite different text of a few words", None, None, 1)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn(
        "deep", F.struct(F.create_map(F.lit("b"), F.lit(1)).alias("m")))
    for name, kept in (("exact", {2, 3, 4}), ("near", {1, 4}), ("decontaminate", {1, 2, 3, 4})):
        out = dict(pipeline.STAGES)[name](spark, docs, DATA)
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and set(got) == kept
        for i, r in got.items():
            assert all(r[c] == f"{c}{i}" for c in names) and r.tags == {"a": i} and r.deep.m == {"b": 1}


def test_empty_table_and_very_long_texts(spark, pipeline):
    long = " ".join(f"word{i % 7000}" for i in range(80_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, None, None, None, None)], schema)
    for name, stage in pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        assert {r.doc_id for r in stage(spark, docs, DATA).collect()} == ({1, 3} if name == "near" else {1, 2, 3})


@pytest.mark.parametrize("few", [0, 200_000])
def test_equal_rows_without_ids_are_split(spark, few):
    rows = spark.range(0, 30_000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    _, hot = X._split(X._from_files(rows.toDF("id", "text")).withColumn("digest", X.sha256(F.col("text"))), 2000, few)
    sizes = [r["count"] for r in hot.groupBy("salt").count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 15 and max(sizes) <= 2_100
    got = X.exact_dedup(rows, broadcast_rows=few).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert [tuple(r) for r in got] == [(None, None, 30_000, True, 30_000)]
