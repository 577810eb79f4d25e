"""Queries on changelogs, their application, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import change_filter, image_filter
from tidemark.operators import apply as A, changelog as C
from tidemark.plans.registry import query
from tidemark.sources.changes import as_changes
from tidemark.sources.storage import scratch, table
from tidemark.sources.versioned import VersionedTarget

LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY cluster_time DESC, seq DESC) AS rn FROM ch) WHERE rn = 1)"
TARGET = "doc_key long, cluster_time timestamp_ntz, seq long, value double, props string"


def changes(spark, d) -> DataFrame:
    return as_changes(table(spark, d, "events"))


def start(spark, d) -> DataFrame:
    """A target that holds one row for every customer."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_key"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))


START = "start AS (SELECT c_custkey AS doc_key, 0.0::DOUBLE AS value, '{}' AS props FROM customer)"


@query("""WITH $CH SELECT db, coll, CASE event_type WHEN 'view' THEN 'drop' ELSE op END AS op, doc_key, CASE WHEN op <> 'delete' AND event_type <> 'view' THEN value END AS value, cluster_time, seq FROM ch WHERE seq % 7 <> 0 AND seq % 11 <> 0""")
def cdc_normalise(spark, d):
    """From JSON: each seventh event lacks an op, each eleventh has an unknown one, views stand for drops."""
    c = changes(spark, d)
    op = F.when(F.col("seq") % 7 == 0, None).when(F.col("seq") % 11 == 0, "noop").when(F.col("event_type") == "view", "drop").otherwise(F.col("op"))
    raw = c.select("cluster_time", F.to_json(F.struct(op.alias("op"), F.struct("db", "coll").alias("ns"), F.col("doc_key").alias("key"), "doc", "seq")).alias("payload"))
    return C.normalise(raw, "payload", "struct<value:double,props:string>").select("db", "coll", "op", "doc_key", F.col("doc.value").alias("value"), "cluster_time", "seq")


@query("WITH $CH SELECT db, coll, " + ", ".join(f"count(*) FILTER (op = '{o}') AS n_{o}" for o in (*C.DML, *C.DDL)) + ", count(*) AS total FROM ch GROUP BY db, coll")
def cdc_op_counts(spark, d):
    return C.op_counts(changes(spark, d))


@query("""WITH $CH, n AS (SELECT *, row_number() OVER (PARTITION BY db, coll ORDER BY cluster_time, seq) - 1 AS n FROM ch)
SELECT coll, seq, n, 'n1-' || coll || '-' || (n // 100) AS batch_id, 'n1-' || n || '-' || epoch_us(cluster_time) AS event_id FROM n""")
def cdc_sequence(spark, d):
    return C.sequenced(changes(spark, d), "n1", 100).select("coll", "seq", "n", "batch_id", "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events")
def cdc_dense_sequence(spark, d):
    from tidemark.functions.columns import micros
    from tidemark.operators.sequence import numbered

    return numbered(table(spark, d, "events").select("event_id", "ts"), micros(F.col("ts")), [F.col("event_id")]).select("event_id", "rn")


@query(f"WITH $CH, {LAST} SELECT doc_key, op, seq, value FROM last")
def cdc_collapse(spark, d):
    return C.latest(changes(spark, d), ["doc_key"]).select("doc_key", "op", "seq", F.col("doc.value").alias("value"))


APPLIED = f"WITH $CH, {LAST}, {START} SELECT * FROM start WHERE doc_key NOT IN (SELECT doc_key FROM last) UNION ALL SELECT doc_key, value, props FROM last WHERE op <> 'delete'"


@query(APPLIED)
def cdc_apply(spark, d):
    return A.apply_changes(start(spark, d), changes(spark, d))


@query(f"WITH $CH, {START} SELECT * FROM start WHERE doc_key NOT IN (SELECT doc_key FROM ch WHERE op = 'delete')")
def cdc_delete(spark, d):
    return A.delete(start(spark, d), changes(spark, d).filter("op = 'delete'"), "doc_key")


BATCH = "b AS (SELECT user_id AS doc_key, max(value) AS value, min(props) AS props FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


def batch(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("doc_key")).agg(F.max("value").alias("value"), F.min("props").alias("props"))


@query(f"WITH {START}, {BATCH} SELECT * FROM start UNION ALL SELECT * FROM b WHERE doc_key NOT IN (SELECT doc_key FROM start)")
def cdc_insert_ignore(spark, d):
    return A.insert_ignore(start(spark, d), batch(spark, d), "doc_key")


@query("WITH $CH SELECT seq, doc_key, op FROM ch WHERE (cluster_time, seq) > (TIMESTAMP '2024-01-15', 100)")
def cdc_replay_after(spark, d):
    return C.after(changes(spark, d), "2024-01-15 00:00:00", 100).select("seq", "doc_key", "op")


@query("WITH $CH SELECT coll, seq FROM ch WHERE seq > CASE coll WHEN 'c0' THEN 300 WHEN 'c1' THEN 600 ELSE -1 END")
def cdc_guard_seq(spark, d):
    state = spark.createDataFrame([("shop", "c0", 300), ("shop", "c1", 600)], "db string, coll string, last_seq long")
    return A.guard(changes(spark, d), state, ["db", "coll"]).select("coll", "seq")


@query("WITH $CH SELECT seq, cluster_time FROM ch WHERE cluster_time >= TIMESTAMP '2024-01-20'")
def cdc_fence(spark, d):
    return A.from_fence(changes(spark, d), "2024-01-20 00:00:00").select("seq", "cluster_time")


@query("""WITH $CH, x AS (SELECT db, coll, CASE WHEN seq % 401 = 400 THEN 'drop' ELSE op END AS op, seq, cluster_time FROM ch), t AS (SELECT coll, max((cluster_time, seq)) AS m FROM x WHERE op = 'drop' GROUP BY coll)
SELECT coll, op, seq FROM x LEFT JOIN t USING (coll) WHERE op <> 'drop' AND (m IS NULL OR (cluster_time, seq) > m)""")
def cdc_drop(spark, d):
    c = changes(spark, d).withColumn("op", F.when(F.col("seq") % 401 == 400, "drop").otherwise(F.col("op")))
    return A.after_drops(c).select("coll", "op", "seq")


@query("SELECT event_id AS entry_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def cdc_pending(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("entry_id"), "event_type")
    return C.pending(e, e.filter("event_type = 'click'"))


@query("WITH $CH SELECT seq, CASE WHEN op IN ('update', 'replace') AND NOT value > 5 THEN 'delete' ELSE op END AS op FROM ch WHERE op = 'delete' OR value > 5 OR op IN ('update', 'replace')")
def cdc_filter_rows(spark, d):
    """A row updated out of the filter becomes a delete."""
    return change_filter(changes(spark, d), [{"field": "value", "operator": "gt", "value": 5}], on_exit="delete").select("seq", "op")


@query("WITH $CH SELECT seq, op, doc_key, value FROM ch")
def cdc_filter_fields(spark, d):
    return image_filter(changes(spark, d), include=("value",)).select("seq", "op", "doc_key", "doc.*")


@query("""WITH x AS (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 1 MINUTE ELSE INTERVAL 10 MINUTE END FROM events),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY event_id ORDER BY ts) AS gap FROM x) SELECT event_id, ts FROM g WHERE gap IS NULL OR gap > INTERVAL 5 MINUTE""")
def cdc_dedup_ttl(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    again = e.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.expr("ts + INTERVAL 1 MINUTE")).otherwise(F.expr("ts + INTERVAL 10 MINUTE")))
    return C.first_within(e.unionByName(again), ["event_id"], 300, "ts")


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def recent_events(spark, d):
    return C.recent(table(spark, d, "events").select("event_id", F.col("ts").alias("cluster_time")), 86400).withColumnRenamed("cluster_time", "ts")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def newest_n(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


def _target(spark, schema="doc_key long, value double, props string", key="doc_key") -> VersionedTarget:
    return VersionedTarget(spark, scratch(spark), schema, key)


@query(f"WITH {START}, {BATCH} SELECT * FROM start UNION ALL SELECT * FROM b WHERE doc_key NOT IN (SELECT doc_key FROM start)")
def sink_insert_ignore(spark, d):
    t = _target(spark)
    t.commit(start(spark, d), None, -1, 0)
    t.insert_new(batch(spark, d), 1)
    return t.read()


@query(f"WITH {START}, {BATCH} SELECT * FROM start WHERE doc_key NOT IN (SELECT doc_key FROM b) UNION ALL SELECT * FROM b")
def sink_upsert(spark, d):
    """The batch is applied twice; the second time does nothing."""
    t = _target(spark)
    t.commit(start(spark, d), None, -1, 0)
    t.commit(batch(spark, d), None, 10, 1)
    t.commit(batch(spark, d).withColumn("value", F.lit(-1.0)), None, 10, 1)
    return t.read()


@query(f"WITH {START}, {BATCH} SELECT * FROM start WHERE doc_key NOT IN (SELECT doc_key FROM b)")
def sink_delete(spark, d):
    t = _target(spark)
    t.commit(start(spark, d), None, -1, 0)
    t.commit(None, batch(spark, d), 10, 1)
    return t.read()


@query(f"WITH {BATCH} SELECT * FROM b")
def sink_replace(spark, d):
    t = _target(spark)
    t.commit(start(spark, d), None, -1, 0)
    t.commit(batch(spark, d), None, 10, 1, replace=True)
    return t.read()


@query("SELECT 'shop.c' || (user_id % 3) AS name, max(event_id) AS last_seq, count(*) AS docs_total FROM events GROUP BY 1")
def sink_state(spark, d):
    """State rows upserted half by half with the operator the data uses."""
    t = _target(spark, "name string, last_seq long, docs_total long", "name")
    s = changes(spark, d).withColumn("name", F.concat_ws(".", "db", "coll"))
    for i, part in enumerate((s.filter("seq < 500"), s)):
        t.commit(part.groupBy("name").agg(F.max("seq").alias("last_seq"), F.count("*").alias("docs_total")), None, i, i)
    return t.read()


@query("""SELECT 'entry' AS kind, event_id AS id, event_type AS name, props AS message, 0.0::DOUBLE AS value FROM events UNION ALL
SELECT 'metric', -1, event_type, NULL, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM events GROUP BY event_type""")
def log_export_roundtrip(spark, d):
    """Entries of the log and metrics over them, exported as lines of JSON and read back."""
    to, e = scratch(spark), table(spark, d, "events")
    entries = e.select(F.lit("entry").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("message"), F.lit(0.0).alias("value"))
    metrics = e.groupBy(F.col("event_type").alias("name")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")).withColumns({"kind": F.lit("metric"), "id": F.lit(-1).cast("long")})
    entries.unionByName(metrics, allowMissingColumns=True).write.json(to)
    return spark.read.schema("kind string, id long, name string, message string, value double").json(to)
