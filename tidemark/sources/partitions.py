"""Tables by time partition, whose old partitions leave whole, and batches fanned out to several sinks with one commit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd"}


class TimePartitions:
    """Rows by the hour or day of a time column. Expiry deletes the folders of whole partitions and rewrites nothing; rows of the partition that the limit
    cuts through are left out by readers."""

    def __init__(self, spark: SparkSession, root: str, schema: str, ts: str, unit: str = "hour"):
        self.spark, self.root, self.schema, self.ts, self.format = spark, root.rstrip("/"), schema, ts, UNITS[unit]

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """With a batch number, a repeated batch replaces its own rows."""
        part = rows.withColumn("part", F.coalesce(F.date_format(self.ts, self.format), F.lit("none")))
        part.repartition("part").withColumn("batch", F.lit(-1 if batch is None else batch)).write.partitionBy("part", "batch").option("partitionOverwriteMode", "dynamic").mode(
            "append" if batch is None else "overwrite").parquet(f"{self.root}/data")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        path, fs = self._fs()
        return sorted(n[5:] for s in (fs.listStatus(path) if fs.exists(path) else ()) if (n := s.getPath().getName()).startswith("part="))

    def expire(self, oldest: Column) -> list[str]:
        """Let go of the partitions that end before `oldest`, by name; those without a time stay."""
        limit = self.spark.range(1).select(F.date_format(oldest, self.format)).first()[0]
        path, fs = self._fs()
        gone = [p for p in self.parts() if p != "none" and p < limit]
        for p in gone:
            fs.delete(path.suffix(f"/part={p}"), True)
        return gone

    def read(self, oldest: Column | None = None) -> DataFrame:
        try:
            found = self.spark.read.schema(f"{self.schema}, part string, batch long").parquet(f"{self.root}/data").drop("part", "batch")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return found if oldest is None else found.filter(F.col(self.ts).isNull() | (F.col(self.ts) >= oldest))


class FanOut:
    """Micro-batches dealt to `sinks` sinks. One write holds the rows of all, and one marker commits them together: a reader of any sink sees a batch only
    once all sinks have it, and a batch that is run again replaces itself."""

    def __init__(self, spark: SparkSession, root: str, schema: str, sinks: int, how: str, by: str | None = None):
        """`how`: "key", by the hash of the column `by`; "round_robin", by the dense number in `by`; "broadcast", every row to every sink."""
        if how not in ("key", "round_robin", "broadcast"):
            raise ValueError(f"unknown distribution {how}")
        self.spark, self.root, self.schema, self.sinks, self.how, self.by = spark, root.rstrip("/"), schema, sinks, how, by

    def batch(self, rows: DataFrame, batch: int) -> None:
        one = {"key": lambda: F.pmod(F.xxhash64(self.by), F.lit(self.sinks)), "round_robin": lambda: F.pmod(F.col(self.by), F.lit(self.sinks)),
               "broadcast": lambda: F.explode(F.sequence(F.lit(0), F.lit(self.sinks - 1)))}[self.how]()
        rows.withColumn("sink", one).withColumn("sink", F.col("sink").cast("int")).repartition("sink").write.partitionBy("sink").parquet(f"{self.root}/data/batch={batch}", mode="overwrite")
        self.spark.range(1).coalesce(1).write.parquet(f"{self.root}/commits/batch={batch}", mode="overwrite")

    def read(self, sink: int | None = None) -> DataFrame:
        """Rows of committed batches, with `sink` and `batch`."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in (fs.listStatus(path) if fs.exists(path) else ()) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        schema = f"{self.schema}, batch long, sink int"
        if not done:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{b}" for b in done])
        return found if sink is None else found.filter(F.col("sink") == sink)
