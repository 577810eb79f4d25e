"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them can read")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: Whether the shuffle files of a query go as it ends. Else they stay until the driver happens to collect its garbage, beside those of later steps.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile leaves no shuffle files; the session's own setting comes back afterwards."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: later work starts from the files, not from the lineage. Also its path, for forget()."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return written(df)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more: all that came from them is written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


#: Ids are broadcast only where they are no more than this, as counted; a row of ids and a few numbers takes some 100 bytes.
BROADCAST_ROWS = 200_000
#: Steps that a query repeats broadcast no more than this: the driver keeps all of a query's broadcasts until it collects its garbage.
FEW_ROWS = 25_000
#: Bits of the table that tells listed ids from most others: 2 MB, however many ids there are.
BITS = 24


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The table as it is where the rows of a join, as counted, are few; else marked so that the join broadcasts neither side. Spark goes by the bytes
    of files: 10 MB of Parquet hold millions of rows of ids, and lanes repeat each of them, while the driver needs some 70 bytes for each row."""
    return df if rows <= FEW_ROWS else df.hint("shuffle_merge")


def small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its rows are few, as counted just now, and else against it. `df` should be a written table."""
    n = df.count()
    return F.broadcast(df) if n <= FEW_ROWS else spread(df, n)


def likely(rows: DataFrame, ids: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """Rows whose `id` is in a written table of ids, and where these are many, a share of the others: who needs only those joins again. So wide rows
    are not shuffled, and what is broadcast does not grow with the ids. `then` maps the batches of what is left, to rows of `schema`: in the same
    step, as each step of a task has a Python worker of its own, which lives on with what it holds."""
    if ids.count() <= FEW_ROWS:
        few = rows.join(F.broadcast(ids), "id", "left_semi")
        return few.mapInArrow(then, schema) if then else few
    code = F.xxhash64("id")
    bit = F.explode(F.array(code.bitwiseAND(2**BITS - 1), F.shiftrightunsigned(code, BITS).bitwiseAND(2**BITS - 1)))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits")).toArrow()
    known = np.zeros(2 ** (BITS - 6), np.uint64)
    known[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    said = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            code = x["_code"].to_numpy().view(np.uint64)
            ok = np.ones(x.num_rows, bool)
            for at in (code & np.uint64(2**BITS - 1), code >> np.uint64(BITS) & np.uint64(2**BITS - 1)):
                ok &= (said.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield x.drop_columns(["_code"]).filter(pa.array(ok))

    coded = rows.withColumn("_code", code)
    return coded.mapInArrow(lambda batches: then(run(batches)), schema) if then else coded.mapInArrow(run, rows.schema)


def meet(rows: DataFrame, listed: DataFrame, on: list[str], how: str, by: str | Column = "id", broadcast_rows: int = BROADCAST_ROWS, lanes: int = 64) -> DataFrame:
    """Join rows with a written table that has a key once, where a key may hold very many of the rows.

    The table is broadcast while it is small, as counted. Beyond that it stands once in each of `lanes` lanes, and rows meet it by key and by the lane
    of `by`, so that no task gets all rows of a key. `by` should differ between rows; if it may be null or repeated for very many of them, and the rows
    come straight from files, it can be their place (F.monotonically_increasing_id()), which a task that is run again finds the same.
    """
    n = listed.count()
    if n <= broadcast_rows:
        return rows.join(F.broadcast(listed), on, how)
    many = spread(listed.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))), n * lanes)
    return rows.withColumn("_lane", F.pmod(F.xxhash64(by), F.lit(lanes)).cast("int")).join(many, [*on, "_lane"], how).drop("_lane")


#: What a worker keeps for the tasks that follow, such as the words that a codec has learned.
KEPT: dict = {}


def let_go() -> None:
    """Drop what another operator's tasks kept: the workers that a task finds may have run any operator before."""
    if KEPT:
        KEPT.clear()
        give_back()


def give_back() -> None:
    """Hand freed memory of a Python worker back to the system: workers live on, and another job of the executor may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not every system has it
        pass


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))
