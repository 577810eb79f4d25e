"""Streaming queries: run with availableNow to the end of the events, read back, and compared with batch SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators import changelog as C
from tidemark.operators.changelog import latest
from tidemark.plans.cdc import LAST, TARGET
from tidemark.plans.registry import query
from tidemark.sources.changes import EVENTS, as_changes, stream
from tidemark.sources.partitions import FanOut, TimePartitions
from tidemark.sources.storage import scratch, table
from tidemark.sources.versioned import VersionedTarget
from tidemark.streaming import jobs as J
from tidemark.streaming.alerting import AlertStream


#: Bytes of a row group in files that must stay whole: tasks share a file by its row groups.
ROW_GROUP = 4 << 20


def _events(spark, d) -> DataFrame:
    return stream(spark, d, "events.parquet")


def _dealt(spark, to: str, batches: int) -> dict:
    """A folder of files as a source of so many batches. A batch has several files, as many as there are cores where rows suffice, so all tasks have a share of
    what writes and reads it: a file of one row group is a task's, however long it is."""
    return {"folder": to, "files_per_batch": max(1, -(-len(spark.read.parquet(to).inputFiles()) // batches))}


def _parts(spark, batches: int) -> int:
    return batches * spark.sparkContext.defaultParallelism


def _in_files(spark, d, n: int) -> dict:
    """The events in n batches of files, by time."""
    to = scratch(spark)
    table(spark, d, "events").repartitionByRange(_parts(spark, n), "ts").write.parquet(to)
    return _dealt(spark, to, n)


def _in_order(spark, d, n: int) -> str:
    """The events in n files that are written one after the other, so that a stream finds them in the order of time."""
    to, e = scratch(spark), table(spark, d, "events")
    cuts = [None, *e.agg(F.percentile_approx(micros(F.col("ts")), [i / n for i in range(1, n)], 10_000)).first()[0], None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        at = micros(F.col("ts"))
        e.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)).coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(to)
    return to


def _appended(spark, df: DataFrame, schema: str) -> DataFrame:
    out = scratch(spark)
    J.run(df, lambda rows, i: rows.write.parquet(f"{out}/batch={i}", mode="overwrite"), f"{scratch(spark)}")
    return spark.read.schema(schema).parquet(f"{out}/*")


def _upserted(spark, df: DataFrame, schema: str, key: str) -> DataFrame:
    """The last value of every key of a stream in update mode."""
    t = VersionedTarget(spark, scratch(spark), schema, key)
    J.run(df, lambda rows, i: t.commit(rows, None, i, i) and None, scratch(spark), "update")
    return t.read()


STATE = f"WITH $CH, {LAST} SELECT doc_key, seq, value FROM last WHERE op <> 'delete'"


@query(STATE)
def stream_apply(spark, d):
    t = VersionedTarget(spark, scratch(spark), TARGET, "doc_key")
    J.apply_stream(as_changes(_events(spark, d)), t, scratch(spark), ["value", "props"])
    return t.read().select("doc_key", "seq", "value")


@query(STATE)
def stream_resume(spark, d):
    """Two batches of the first half, a stop, then the second half and a restart from the checkpoint."""
    files, checkpoint = scratch(spark), scratch(spark)
    t = VersionedTarget(spark, scratch(spark), TARGET, "doc_key")
    events = table(spark, d, "events")
    half = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    events.filter(F.col("event_id") <= half).repartition(_parts(spark, 2)).write.parquet(files)
    source = as_changes(stream(spark, **_dealt(spark, files, 2)))
    J.apply_stream(source, t, checkpoint, ["value", "props"])
    events.filter(F.col("event_id") > half).repartitionByRange(_parts(spark, 1), "event_id").write.mode("append").parquet(files)
    J.apply_stream(as_changes(stream(spark, **_dealt(spark, files, 3))), t, checkpoint, ["value", "props"])
    return t.read().select("doc_key", "seq", "value")


def _fence(c: DataFrame, until) -> DataFrame:
    """The position of the log up to `until`, by table."""
    return c.filter(until).groupBy("db", "coll").agg(F.max(F.struct("cluster_time", "seq")).alias("p")).select("db", "coll", "p.*")


@query(STATE)
def rebootstrap(spark, d):
    """The log is invalid two fifths through: the target starts over from a snapshot taken at three fifths, and goes on with changes from before and after
    it, in files out of order."""
    c = as_changes(table(spark, d, "events"))
    low, fence = c.agg(F.percentile_approx("seq", [0.4, 0.6])).first()[0]
    files = scratch(spark)
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") == low, "invalidate").otherwise(F.col("event_type")))
    e.repartition(_parts(spark, 5), F.xxhash64("event_id")).write.parquet(files)  # every file holds changes from all over the log
    t = VersionedTarget(spark, scratch(spark), TARGET, "doc_key")

    def snapshot():
        whole = latest(c.filter(F.col("seq") <= fence), ["doc_key"]).filter("op <> 'delete'").select("db", "coll", "doc_key", "cluster_time", "seq", "doc.*")
        return whole, _fence(c, F.col("seq") <= fence)

    source = as_changes(stream(spark, **_dealt(spark, files, 5))).withColumn("op", F.when(F.col("event_type") == "invalidate", "invalidate").otherwise(F.col("op")))
    J.apply_stream(source, t, scratch(spark), ["value", "props"], snapshot=snapshot)
    return t.read().select("doc_key", "seq", "value")


DROPPED = """WITH $CH, x AS (SELECT db, coll, CASE WHEN seq % 997 = 500 THEN 'drop' WHEN seq = (SELECT max(seq) // 3 FROM ch) THEN 'dropDatabase' WHEN seq % 499 = 3 THEN 'rename' ELSE op END AS op, doc_key, value, cluster_time, seq FROM ch),
t AS (SELECT coll, max((cluster_time, seq)) AS m FROM x WHERE op = 'drop' GROUP BY coll), b AS (SELECT max((cluster_time, seq)) AS m FROM x WHERE op = 'dropDatabase'),
kept AS (SELECT x.* FROM x LEFT JOIN t USING (coll), b WHERE op IN ('insert', 'update', 'replace', 'delete') AND (t.m IS NULL OR (cluster_time, seq) > t.m) AND (b.m IS NULL OR (cluster_time, seq) > b.m)),
last AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY cluster_time DESC, seq DESC) AS rn FROM kept)"""


def _with_ddl(e: DataFrame, top: int) -> DataFrame:
    c = as_changes(e)
    s = F.col("seq")
    return c.withColumn("op", F.when(s % 997 == 500, "drop").when(s == top // 3, "dropDatabase").when(s % 499 == 3, "rename").otherwise(F.col("op")))


def _shuffled(spark, d, n: int) -> dict:
    """The events in n batches of files, each with rows from all over the log."""
    to = scratch(spark)
    table(spark, d, "events").repartition(_parts(spark, n), F.xxhash64("event_id")).write.parquet(to)
    return _dealt(spark, to, n)


@query(DROPPED + " SELECT doc_key, seq, value FROM last WHERE rn = 1 AND op <> 'delete'")
def stream_drop(spark, d):
    """Tables and once the database are dropped in the middle of the log; files, and so drops and changes, come in any order."""
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    t = VersionedTarget(spark, scratch(spark), TARGET, "doc_key")
    J.apply_stream(_with_ddl(stream(spark, **_shuffled(spark, d, 5)), top), t, scratch(spark), ["value", "props"])
    return t.read().select("doc_key", "seq", "value")


@query("WITH $CH, x AS (SELECT *, CASE WHEN seq % 997 = 500 THEN 'drop' WHEN seq = (SELECT max(seq) // 3 FROM ch) THEN 'dropDatabase' WHEN seq % 499 = 3 THEN 'rename' END AS ddl FROM ch) SELECT db, coll, ddl AS op, seq, cluster_time AS at FROM x WHERE ddl IS NOT NULL")
def stream_audit(spark, d):
    """What the stream saw of DDL, on record."""
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    t = VersionedTarget(spark, scratch(spark), TARGET, "doc_key")
    J.apply_stream(_with_ddl(stream(spark, **_in_files(spark, d, 2)), top), t, scratch(spark), ["value", "props"])
    return t.notes("audit").select("db", "coll", "op", "seq", F.col("at").cast("timestamp_ntz").alias("at"))


def _numbered(spark, d) -> DataFrame:
    """Positions of the changes of two clients, numbered without gaps per client and table, in batches of 500 of each client."""
    c = as_changes(table(spark, d, "events")).select("db", "coll", F.when(F.col("doc_key") % 7 < 3, "east").otherwise("west").alias("client"), "cluster_time", "seq")
    c = C.dense(c, ["client", "db", "coll"])
    return c.withColumn("batch", F.floor(F.col("n") / 500))


GUARDED = """WITH $CH, x AS (SELECT *, CASE WHEN doc_key % 7 < 3 THEN 'east' ELSE 'west' END AS client FROM ch),
n AS (SELECT *, row_number() OVER (PARTITION BY client, db, coll ORDER BY cluster_time, seq) - 1 AS n FROM x),
g AS (SELECT * FROM n WHERE NOT (client = 'east' AND coll = 'c1' AND n // 500 = 1))"""


@query(GUARDED + """ SELECT client, coll, CASE WHEN client = 'east' AND coll = 'c1' AND max(n) > 499 THEN 499 ELSE max(n) END AS acked_seq, max(n) AS last_seq,
CASE WHEN client = 'east' AND coll = 'c1' AND max(n) > 999 THEN 1 ELSE 0 END AS gaps, count(*) AS applied FROM g GROUP BY client, coll""")
def stream_guard(spark, d):
    """Two clients; batches come late and twice, under new batch numbers, and one never comes: its gap stays open, nothing is applied twice."""
    c, root = _numbered(spark, d), scratch(spark)
    log = c.select(F.concat_ws("/", "client", "coll", "n").alias("n_key"), F.lit("insert").alias("op"), "db", "coll", "client", F.struct("client", "coll").alias("doc"), "cluster_time", F.col("n").alias("seq"), "batch").persist()
    try:
        t = VersionedTarget(spark, root, "n_key string, client string, coll string, cluster_time timestamp_ntz, seq long", "n_key")
        even, odd = F.col("batch") % 2 == 0, F.col("batch") % 2 == 1
        lost = (F.col("client") == "east") & (F.col("coll") == "c1") & (F.col("batch") == 1)
        for i, part in enumerate((log.filter(even), log.filter(odd & ~lost), log.filter(even), log.filter(~lost))):  # late ones second, replays third and fourth
            who = "east" if i % 2 else "west"
            t.apply(part.filter(F.col("client") != who), 10 + i, ["client", "coll"], f"s{who}", "client")
            t.apply(part.filter(F.col("client") == who), i, ["client", "coll"], who, "client")
            t.apply(log, i, ["client", "coll"], who, "client")  # a batch that was acknowledged is not looked at again
        applied = t.read().groupBy("client", "coll").agg(F.count("*").alias("applied"))
        return t.positions().join(applied, ["client", "coll"]).select("client", "coll", "acked_seq", "last_seq", F.col("gaps").cast("long").alias("gaps"), "applied")
    finally:
        log.unpersist()


@query("""WITH f AS (SELECT *, CASE WHEN user_id % 7 < 3 THEN 'east' ELSE 'west' END AS client FROM events)
SELECT client, count(*) AS docs, max(event_id) AS end_seq, 'completed' AS status FROM f GROUP BY client""")
def stream_ledger(spark, d):
    """Three batches of files; the second fails once, after its rows were written but before the commit, and is run again on restart."""
    files, checkpoint = _in_files(spark, d, 3), scratch(spark)
    t = VersionedTarget(spark, scratch(spark), TARGET, "doc_key")
    source = lambda: as_changes(stream(spark, **files)).withColumn("client", F.when(F.col("doc_key") % 7 < 3, "east").otherwise("west"))
    commits, write = [], t._write_notes

    def once(m, notes):
        commits.append(m.version)
        if len(commits) == 2:
            raise RuntimeError("the disk is gone")
        write(m, notes)

    t._write_notes = once
    try:
        J.apply_stream(source(), t, checkpoint, ["value", "props"], client="client", dense=False)
    except StreamingQueryException:
        pass
    if t.ledger().filter("status = 'failed'").count() != 1:
        raise AssertionError("the failure is not on record")
    J.apply_stream(source(), t, checkpoint, ["value", "props"], client="client", dense=False)
    return t.ledger().groupBy("client", "status").agg(F.sum("docs").alias("docs"), F.max("end_seq").alias("end_seq")).select("client", "docs", "end_seq", "status")


@query("WITH $CH, w AS (SELECT TIMESTAMP '2024-01-10' AS oldest) SELECT seq, op FROM ch, w WHERE cluster_time >= oldest")
def gap_recovery(spark, d):
    """A position older than the retained log starts again from the oldest entry kept."""
    from tidemark.operators.apply import from_fence
    from tidemark.operators.state import resume_validity

    c = as_changes(table(spark, d, "events"))
    log = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-02-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("cluster_time"))
    position = spark.createDataFrame([("2024-01-02 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("last_time"))
    begin = resume_validity(position, log).first()["start"]
    return from_fence(c, str(begin)).select("seq", "op")


@query("SELECT user_id % 4 AS shard, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_by_key(spark, d):
    """Several sinks fed from one batch, by key."""
    files, out = _in_files(spark, d, 3), scratch(spark)

    def one(rows: DataFrame, i: int) -> None:
        rows.select(F.col("user_id") % 4, "event_id").toDF("shard", "event_id").repartition(4, "shard").write.partitionBy("shard").parquet(f"{out}/batch={i}", mode="overwrite")

    J.run(stream(spark, **files), one, scratch(spark))
    return spark.read.schema("event_id long, batch int, shard long").option("basePath", out).parquet(f"{out}/*").groupBy("shard").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("""SELECT 'key' AS how, (-1)::INT AS sink, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events UNION ALL
SELECT 'round_robin', (event_id % 3)::INT, count(*), sum(event_id)::BIGINT FROM events GROUP BY 2 UNION ALL SELECT 'broadcast', s::INT, count(*), sum(event_id)::BIGINT FROM events, range(0, 3) r(s) GROUP BY s""")
def stream_fan_out(spark, d):
    """Each batch to three sinks at once: by key (every row once, a key in one sink alone), round robin, and to all."""
    out = None
    for how, by in (("key", "user_id"), ("round_robin", "event_id"), ("broadcast", None)):
        f = FanOut(spark, scratch(spark), "event_id long, user_id long", 3, how, by)
        J.run(stream(spark, **_in_files(spark, d, 3)).select("event_id", "user_id"), f.batch, scratch(spark))
        f.batch(table(spark, d, "events").select("event_id", "user_id").repartitionByRange(3, "event_id").limit(0), 99)
        rows = f.read()
        if how == "key":
            rows = rows.groupBy("user_id", "sink").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).groupBy("user_id").agg(F.count("*").alias("sinks"), F.sum("n").alias("n"), F.sum("ids").alias("ids")).filter("sinks = 1")
            one = rows.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).select(F.lit(how).alias("how"), F.lit(-1).alias("sink"), "n", "ids")
        else:
            one = rows.groupBy("sink").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.lit(how).alias("how"), "sink", "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH m AS (SELECT max(ts) - INTERVAL 24 HOUR AS oldest FROM events)
SELECT event_id, ts, (SELECT count(DISTINCT date_trunc('hour', ts)) FROM events, m WHERE ts >= date_trunc('hour', oldest)) AS parts FROM events, m WHERE ts >= oldest""")
def metrics_retention(spark, d):
    """Metrics older than 24 hours leave after each batch, by whole hours; the last partition cut is told apart by readers."""
    t = TimePartitions(spark, scratch(spark), "event_id long, ts timestamp_ntz", "ts")
    newest, seen = table(spark, d, "events").agg(F.max("ts")).first()[0], []

    def one(rows: DataFrame, i: int) -> None:
        t.append(rows, i)
        seen.append(rows.agg(F.max("ts")).first()[0])  # files may come in any order
        t.expire(F.lit(max(seen)) - F.expr("INTERVAL 24 HOURS"))

    J.run(stream(spark, **_in_files(spark, d, 4)).select("event_id", "ts"), one, scratch(spark))
    return t.read(F.lit(newest) - F.expr("INTERVAL 24 HOURS")).withColumn("parts", F.lit(len(t.parts())).cast("long"))


@query("SELECT event_id, ts FROM events")
def stream_dedup(spark, d):
    """Every event twice; the second is dropped."""
    e = _events(spark, d).select("event_id", "ts")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _appended(spark, J.dedup(twice, ["event_id"], "5 minutes", "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "event_id long, ts timestamp_ntz")


WINDOWED = "SELECT strftime(time_bucket(INTERVAL {0}, ts), '%Y-%m-%d %H:%M:%S') || ' ' || event_type AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {1} GROUP BY 1"
KEYED = "k string, n long, total double"


def _keyed(w: DataFrame) -> DataFrame:
    return w.select(F.concat_ws(" ", F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "event_type").alias("k"), "n", F.col("total").cast("double").alias("total"))


@query("""SELECT strftime(b - INTERVAL (10 * i) SECOND, '%Y-%m-%d %H:%M:%S') || ' ' || event_type AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM (SELECT *, time_bucket(INTERVAL 10 SECOND, ts) AS b FROM events) e, range(0, 6) r(i) GROUP BY 1""")
def stream_rate(spark, d):
    return _upserted(spark, _keyed(J.windowed(_events(spark, d), "ts", ["event_type"], "value", "60 seconds", "10 seconds", "40 days")), KEYED, "k")


@query(WINDOWED.format("1 HOUR", "events"))
def stream_chart(spark, d):
    return _upserted(spark, _keyed(J.windowed(_events(spark, d), "ts", ["event_type"], "value", "1 hour", None, "40 days")), KEYED, "k")


@query("SELECT 'k' || (user_id % 7) || '.c' || (user_id % 3) AS client, max(event_id) AS last_seq, count(*) AS n FROM events GROUP BY 1")
def stream_clients(spark, d):
    c = as_changes(_events(spark, d)).withColumn("client", F.concat(F.lit("k"), F.col("doc_key") % 7, F.lit("."), F.col("coll")))
    return _upserted(spark, J.positions(c, ["client"]).select("client", "last_seq", "n"), "client string, last_seq long, n long", "client")


@query("""WITH x AS (SELECT event_type AS key, ts AS moment, value, value > 40 AS breach, lag(value > 40, 1, false) OVER (PARTITION BY event_type ORDER BY ts, value) AS before FROM events)
SELECT key, moment, CASE WHEN breach THEN 'raised' ELSE 'resolved' END AS state, value FROM x WHERE breach <> before""")
def stream_alerts(spark, d):
    """One rule without cooldown for every event type."""
    rules = spark.createDataFrame([("r", "m", "gt", 40.0, 0)], "id string, type string, op string, limit double, cooldown long")
    alerts = AlertStream(spark, scratch(spark), lambda: rules)
    alerts.run(_events(spark, d).select(F.lit("m").alias("type"), F.lit("d").alias("db"), F.col("event_type").alias("coll"), F.col("ts").alias("at"), "value"), scratch(spark))
    return alerts.transitions().select(F.split_part("alert", F.lit("/"), F.lit(3)).alias("key"), F.col("at").cast("timestamp_ntz").alias("moment"), F.col("said").alias("state"), "value")


#: Rules of the query below: id, type, name, component, db, coll, comparison, limit, cooldown in seconds. A blank holds for all.
RULES = [("clicks", "lag", "click", "", "", "", "gt", 40.0, 6 * 3600), ("late", "lag", "", "", "shop", "c1", "gte", 60.0, 0), ("low", "errors", "", "k3", "", "", "lt", 5.0, 24 * 3600), ("none", "errors", "", "", "", "c9", "eq", 1.0, 60)]


@query(f"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) v(id, type, name, component, db, coll, op, lim, cooldown)),
met AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'lag' ELSE 'errors' END AS type, event_type AS name, 'k' || (user_id % 5) AS component, 'shop' AS db, 'c' || (user_id % 3) AS coll, epoch_us(ts) AS us, value FROM events),
x AS (SELECT r.id || '/' || m.db || '/' || m.coll AS alert, us, value, cooldown::BIGINT * 1000000 AS cooldown, CASE op WHEN 'gt' THEN value > lim WHEN 'gte' THEN value >= lim WHEN 'lt' THEN value < lim ELSE value = lim END AS breach
  FROM met m JOIN rules r ON r.type = m.type AND r.name IN ('', m.name) AND r.component IN ('', m.component) AND r.db IN ('', m.db) AND r.coll IN ('', m.coll)),
o AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY us, value) AS rn FROM x),
w AS (SELECT alert, min(rn) AS rn, true AS active, min(us) AS raised FROM o WHERE breach GROUP BY alert
  UNION ALL SELECT w.alert, min(o.rn), NOT any_value(w.active), CASE WHEN any_value(w.active) THEN any_value(w.raised) ELSE min(o.us) END FROM w JOIN o ON o.alert = w.alert AND o.rn > w.rn
    AND CASE WHEN w.active THEN NOT o.breach ELSE o.breach AND o.us >= w.raised + o.cooldown END GROUP BY w.alert)
SELECT alert, CASE WHEN active THEN 'raised' ELSE 'resolved' END AS state, us::BIGINT AS at, value FROM w JOIN o USING (alert, rn)""")
def stream_alert_rules(spark, d):
    """Rules from a table over metrics in three batches, with cooldown. Batches come in the order of time: rows older than an alert's last one are late and only counted."""
    table_of_rules = scratch(spark)
    spark.createDataFrame(RULES, "id string, type string, name string, component string, db string, coll string, op string, limit double, cooldown long").coalesce(1).write.parquet(table_of_rules)
    alerts = AlertStream(spark, scratch(spark), lambda: spark.read.parquet(table_of_rules))
    e = stream(spark, _in_order(spark, d, 3), files_per_batch=1)
    kind = F.when(F.col("user_id") % 2 == 0, "lag").otherwise("errors")
    alerts.run(e.select(kind.alias("type"), F.col("event_type").alias("name"), F.concat(F.lit("k"), F.col("user_id") % 5).alias("component"), F.lit("shop").alias("db"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("coll"), F.col("ts").alias("at"), "value"), scratch(spark))
    return alerts.transitions().select("alert", F.col("said").alias("state"), F.unix_micros("at").alias("at"), "value")
