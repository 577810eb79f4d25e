"""Queries on sync state, observability and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import observe as O, state as S
from tidemark.operators.snapshot import overall, run_tables
from tidemark.plans.cdc import changes
from tidemark.plans.registry import query
from tidemark.plans.spec import TableSpec
from tidemark.sources.storage import table

ST = """st AS (SELECT 'shop' AS db, 'u' || (user_id % 7) AS coll, max(event_id) AS last_key, count(*) AS docs_total, user_id % 7 IN (0, 1, 2) AS initial_done,
  CASE WHEN user_id % 7 IN (0, 1, 2) THEN 'completed' WHEN user_id % 7 = 3 THEN 'in_progress' WHEN user_id % 7 = 4 THEN 'error' ELSE 'pending' END AS status, max(ts) AS updated_at FROM events GROUP BY user_id % 7)"""


def state(spark, d) -> DataFrame:
    k = F.col("user_id") % 7
    e = table(spark, d, "events").groupBy(k.alias("k")).agg(F.max("event_id").alias("last_key"), F.count("*").alias("docs_total"), F.max("ts").alias("updated_at"))
    done = F.col("k").isin(0, 1, 2)
    status = F.when(done, "completed").when(F.col("k") == 3, "in_progress").when(F.col("k") == 4, "error").otherwise("pending")
    return e.select(F.lit("shop").alias("db"), F.concat(F.lit("u"), "k").alias("coll"), "last_key", "docs_total", done.alias("initial_done"), status.alias("status"), "updated_at")


def specs(spark) -> DataFrame:
    return spark.createDataFrame([("shop", f"u{i}") for i in range(7)], "db string, coll string")


def _by_client(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("coll", F.concat(F.lit("u"), F.col("user_id") % 7)).withColumn("db", F.lit("shop"))


@query(f"""WITH {ST}, s AS (SELECT 'shop' AS db, 'u' || i AS coll FROM range(0, 7) r(i))
SELECT db, coll, CASE WHEN initial_done THEN 'incremental' WHEN status = 'in_progress' THEN 'resume' WHEN last_key IS NOT NULL THEN 'clear_full' ELSE 'full' END AS mode FROM s LEFT JOIN (SELECT * FROM st WHERE coll <> 'u6') USING (db, coll)""")
def plan_modes(spark, d):
    """One table of the spec has no state yet."""
    return S.plan_modes(specs(spark), state(spark, d).filter("coll <> 'u6'")).select("db", "coll", "mode")


@query(f"""WITH {ST} SELECT count(*) AS tables, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'in_progress') AS running,
sum(docs_total)::BIGINT AS docs, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'in_progress' END AS status FROM st""")
def status_rollup(spark, d):
    return S.status_rollup(state(spark, d))


@query("SELECT count(*) AS docs, 3::BIGINT AS tables, 2::BIGINT AS completed, 1::BIGINT AS failed, 'error' AS status FROM (SELECT 1 FROM orders UNION ALL SELECT 1 FROM customer)")
def run_status(spark, d):
    """Three tables run side by side; one that does not exist fails and stops none."""
    tables = [TableSpec("shop", c) for c in ("orders", "customer", "no_such_table")]
    status = run_tables(spark, tables, lambda t: table(spark, d, t.coll).count())
    return overall(status).crossJoin(status.agg(F.sum("docs").alias("docs")))


@query("""WITH a AS (SELECT event_type, count(*) AS n_source FROM events GROUP BY 1), b AS (SELECT event_type, count(*) AS n_target FROM events WHERE NOT (event_type = 'click' AND event_id % 2 = 0) AND event_type <> 'view' GROUP BY 1)
SELECT event_type, coalesce(n_source, 0) AS n_source, coalesce(n_target, 0) AS n_target, CASE WHEN coalesce(n_source, 0) = coalesce(n_target, 0) THEN 'skip' ELSE 'resync' END AS action FROM a FULL JOIN b USING (event_type)""")
def reconcile_counts(spark, d):
    e = table(spark, d, "events")
    return S.reconcile(e, e.filter("NOT (event_type = 'click' AND event_id % 2 = 0) AND event_type <> 'view'"), ["event_type"])


@query(f"""WITH {ST}, now AS (SELECT 'u' || (user_id % 7) AS coll, event_id FROM events WHERE event_id % 3 <> 0 AND NOT (user_id % 7 = 1 AND event_id > 100)), c AS (SELECT coll, count(*) AS n FROM now GROUP BY 1)
SELECT 'shop' AS db, st.coll, last_key, last_key IN (SELECT event_id FROM now WHERE now.coll = st.coll) AS last_key_found, coalesce(n, 0) AS n_now, status = 'completed' AND coalesce(n, 0) < docs_total AS shrunk FROM st LEFT JOIN c USING (coll)""")
def state_consistency(spark, d):
    now = _by_client(spark, d).filter("event_id % 3 <> 0 AND NOT (user_id % 7 = 1 AND event_id > 100)")
    return S.consistency(state(spark, d), now, "event_id", ["db", "coll"])


@query("""SELECT event_id FROM events WHERE user_id % 7 IN (3, 4, 5, 6) OR ts > CASE user_id % 7 WHEN 0 THEN TIMESTAMP '2024-01-05' WHEN 1 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-01-25' END""")
def untransferred(spark, d):
    s = spark.createDataFrame([("shop", f"u{i}", "initial" if i > 2 else "incremental", f"2024-01-{10 * i + 5:02d} 00:00:00" if i < 3 else None) for i in range(6)], "db string, coll string, mode string, u string")
    s = s.withColumn("updated_at", F.col("u").cast("timestamp_ntz"))
    return S.untransferred(_by_client(spark, d), s, F.col("ts"), ["db", "coll"]).select("event_id")


@query("""WITH w AS (SELECT min(ts) AS oldest, max(ts) AS newest FROM events WHERE ts >= TIMESTAMP '2024-01-05'), c AS (SELECT user_id % 7 AS client, min(ts) + INTERVAL (user_id % 7) DAY AS last_time FROM events GROUP BY user_id % 7)
SELECT client, last_time BETWEEN oldest AND newest AS valid, CASE WHEN last_time BETWEEN oldest AND newest THEN last_time ELSE oldest END AS start FROM c, w""")
def resume_validity(spark, d):
    e = table(spark, d, "events")
    c = e.groupBy((F.col("user_id") % 7).alias("client")).agg(F.min("ts").alias("t")).withColumn("last_time", F.col("t") + F.make_dt_interval(F.col("client").cast("int")))
    return S.resume_validity(c, e.filter("ts >= '2024-01-05'").select(F.col("ts").alias("cluster_time"))).select("client", "valid", "start")


@query(f"WITH {ST} SELECT count(*) AS total, count(*) FILTER (status = 'in_progress') AS active, count(*) FILTER (status = 'error') AS errors, sum(docs_total)::BIGINT AS processed, max(updated_at) AS updated_at FROM st")
def checkpoint_stats(spark, d):
    return S.checkpoint_stats(state(spark, d))


@query("""WITH c AS (SELECT user_id % 7 AS client_id, count(DISTINCT event_type) AS n, user_id % 7 < 4 AS connected FROM events GROUP BY ALL)
SELECT count(*) FILTER (connected) AS connected, count(*) FILTER (NOT connected) AS disconnected, sum(n)::BIGINT AS collections, sum(CASE WHEN connected THEN n ELSE 0 END)::BIGINT AS active_collections FROM c""")
def client_stats(spark, d):
    c = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("client_id")).agg(F.collect_set("event_type").alias("collections"))
    return S.client_stats(c.withColumn("connected", F.col("client_id") < 4))


@query("""SELECT min(ts) AS oldest, max(ts) AS newest, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4) AS hours, CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 < 1 THEN 'risky' WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 < 6 THEN 'caution' ELSE 'good' END AS class FROM events""")
def log_window(spark, d):
    return S.log_window(table(spark, d, "events").select(F.col("ts").alias("cluster_time")))


@query("""WITH l AS (SELECT user_id % 7 AS client, event_id // 100 AS b, count(*) AS docs, max(event_id) AS end_seq, CASE WHEN (event_id // 100) % 10 = 9 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY ALL)
SELECT client, count(*) AS batches, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, sum(CASE WHEN status = 'completed' THEN docs ELSE 0 END)::BIGINT AS docs, max(CASE WHEN status = 'completed' THEN end_seq END) AS watermark FROM l GROUP BY client""")
def ledger_totals(spark, d):
    e = table(spark, d, "events")
    ledger = e.groupBy((F.col("user_id") % 7).alias("client"), F.floor(F.col("event_id") / 100).alias("b")).agg(F.count("*").alias("docs"), F.max("event_id").alias("end_seq"))
    return S.ledger_totals(ledger.withColumn("status", F.when(F.col("b") % 10 == 9, "failed").otherwise("completed")), ["client"])


@query("WITH c AS (SELECT user_id AS client, max(ts) AS last_seen, user_id % 5 = 0 AS connected FROM events WHERE ts < TIMESTAMP '2024-01-20' OR user_id % 2 = 0 GROUP BY ALL) SELECT client, last_seen FROM c WHERE connected OR last_seen >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def retention(spark, d):
    c = table(spark, d, "events").filter("ts < '2024-01-20' OR user_id % 2 = 0").groupBy(F.col("user_id").alias("client")).agg(F.max("ts").alias("last_seen"))
    return S.retain(c.withColumn("connected", F.col("client") % 5 == 0), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("client", "last_seen")


@query("SELECT event_type, count(*) AS events, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def totals(spark, d):
    return O.totals(table(spark, d, "events"), ["event_type"], F.octet_length("props"))


@query("""SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS DOUBLE) / 3600, 6) AS rate FROM events""")
def trailing_rate(spark, d):
    r = O.trailing_rate(table(spark, d, "events"), ["event_type"], "ts", F.col("value").cast("decimal(18,2)").cast("double"), 3600)
    return r.select("event_id", F.round("rate", 6).alias("rate"))


@query("""WITH $CH SELECT coll, arg_max(round((seq % 50) + value / 10, 4), (cluster_time, seq)) AS lag_seconds FROM ch GROUP BY coll""")
def lag_latest(spark, d):
    c = changes(spark, d)
    us = ((F.col("seq") % 50) * 1_000_000 + F.round(F.col("doc.value") * 100_000)).cast("long")
    processed = F.timestamp_micros(F.unix_micros(F.col("cluster_time").cast("timestamp")) + us)
    return O.lag_latest(c, ["coll"], processed)


@query("SELECT user_id % 3 AS coll, count(*) AS n, arg_max(props, (ts, event_id)) AS last_message, max(ts) AS last_time FROM events WHERE event_type = 'error' GROUP BY 1")
def errors_rollup(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("coll", F.col("user_id") % 3)
    return O.errors_rollup(e, ["coll"], "props", "ts", "event_id")


@query("""WITH $CH, l AS (SELECT coll, arg_max(round((seq % 50) + value / 10, 4), (cluster_time, seq)) AS lag FROM ch GROUP BY coll) SELECT round(avg(lag), 4) AS mean_lag, count(lag) AS tables FROM l""")
def lag_mean(spark, d):
    return O.mean_lag(lag_latest(spark, d))


@query("""SELECT user_id % 3 AS coll, 't' || (event_id % 4) AS error_type, count(*) AS n, arg_max(props, (ts, event_id)) AS last_message, arg_max(value, (ts, event_id)) AS last_details, max(ts) AS last_time
FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def errors_by_type(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").withColumns({"coll": F.col("user_id") % 3, "error_type": F.concat(F.lit("t"), F.col("event_id") % 4)})
    return O.errors_rollup(e, ["coll", "error_type"], "props", "ts", "event_id", "value")


@query("""SELECT count(*) FILTER (event_type <> 'error') AS docs, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume,
count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS watchers, (WITH $CH, l AS (SELECT arg_max(round((seq % 50) + value / 10, 4), (cluster_time, seq)) AS lag FROM ch GROUP BY coll) SELECT round(avg(lag), 4) FROM l) AS mean_lag FROM events""")
def dashboard(spark, d):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    bad = F.col("event_type") == "error"
    figures = table(spark, d, "events").agg(F.count_if(~bad).alias("docs"), F.round(F.count("*") / span, 6).alias("per_second"), O.money("value").cast("double").alias("volume"),
                                         F.count_if(bad).alias("errors"), F.count_distinct("event_type").alias("watchers"))
    return figures.join(O.mean_lag(lag_latest(spark, d)).select("mean_lag"))  # one row each


@query("""WITH h AS (SELECT user_id % 10 AS component, arg_max(CASE event_type WHEN 'signup' THEN 'healthy' WHEN 'purchase' THEN 'healthy' WHEN 'click' THEN 'degraded' WHEN 'error' THEN 'unhealthy' ELSE 'unknown' END, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT component, status, CASE status WHEN 'healthy' THEN 1.0::DOUBLE WHEN 'degraded' THEN 0.5 WHEN 'unhealthy' THEN 0.0 ELSE -1.0 END AS value FROM h""")
def health_value(spark, d):
    status = F.when(F.col("event_type").isin("signup", "purchase"), "healthy").when(F.col("event_type") == "click", "degraded").when(F.col("event_type") == "error", "unhealthy").otherwise("unknown")
    h = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("component")).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"))
    return h.withColumn("value", O.health_value(F.col("status")))


@query("""WITH m AS (SELECT event_type AS coll, user_id % 3 AS part, CASE WHEN user_id % 2 = 0 THEN 'lag' ELSE 'errors' END AS type, value, ts, event_id FROM events),
r(type, op, lim, severity, coll) AS (VALUES ('lag', 'gt', 30.0, 'warning', NULL), ('lag', 'gt', 120.0, 'critical', NULL), ('errors', 'gt', 10.0, 'critical', 'click'))
SELECT event_id, severity, value FROM m JOIN r ON m.type = r.type AND (r.coll IS NULL OR r.coll = m.coll) WHERE value > lim""")
def alerts_breach(spark, d):
    rules = spark.createDataFrame([(t, o, v, s, None, "click" if t == "errors" else None) for t, o, v, s in O.DEFAULT_RULES if t in ("lag", "errors")], "type string, op string, limit double, severity string, db string, coll string")
    m = table(spark, d, "events").select("event_id", F.lit("shop").alias("db"), F.col("event_type").alias("coll"), F.when(F.col("user_id") % 2 == 0, "lag").otherwise("errors").alias("type"), "value")
    return O.breaches(rules, m).filter("breach").select("event_id", F.col("r_severity").alias("severity"), "value")


@query("""WITH m AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'lag' ELSE 'errors' END AS type, event_type AS name, 'c' || (user_id % 3) AS component, value FROM events),
r(type, name, component, lim, severity) AS (VALUES ('lag', 'click', NULL, 30.0, 'warning'), ('lag', '', 'c1', 60.0, 'critical'), ('errors', 'error', 'c2', 10.0, 'critical'))
SELECT event_id, severity, value FROM m JOIN r ON m.type = r.type AND (coalesce(r.name, '') = '' OR r.name = m.name) AND (r.component IS NULL OR r.component = m.component) WHERE value > lim""")
def alerts_named(spark, d):
    """Rules that name a metric or a component; what they leave blank holds for all."""
    rules = spark.createDataFrame([("lag", "click", None, "gt", 30.0, "warning"), ("lag", "", "c1", "gt", 60.0, "critical"), ("errors", "error", "c2", "gt", 10.0, "critical")],
                                  "type string, name string, component string, op string, limit double, severity string")
    kind = F.when(F.col("user_id") % 2 == 0, "lag").otherwise("errors")
    m = table(spark, d, "events").select("event_id", kind.alias("type"), F.col("event_type").alias("name"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("component"), "value")
    return O.breaches(rules, m).filter("breach").select("event_id", F.col("r_severity").alias("severity"), "value")


@query("""WITH x AS (SELECT event_type, ts, event_id, value > 40 AS b, lag(value > 40, 1, false) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, CASE WHEN b THEN 'raised' ELSE 'resolved' END AS state FROM x WHERE b <> p""")
def alert_edges(spark, d):
    e = table(spark, d, "events").withColumn("b", F.col("value") > 40)
    return O.alert_edges(e, ["event_type"], ["ts", "event_id"], "b").select("event_id", "state")


LOG = "log AS (SELECT event_id, ts, event_type AS stage, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS level, props AS message, CASE WHEN value > 10 THEN 'ok' ELSE 'low' END AS status, user_id AS correlation FROM events)"


def logs(spark, d) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warning").otherwise("info")
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("stage"), level.alias("level"), F.col("props").alias("message"),
                                            F.when(F.col("value") > 10, "ok").otherwise("low").alias("status"), F.col("user_id").alias("correlation"))


@query(f"WITH {LOG} SELECT level, stage, grouping(level, stage)::BIGINT AS g, count(*) AS n, max(ts) AS last_ts FROM log GROUP BY GROUPING SETS ((level), (stage), ())")
def log_stats(spark, d):
    return O.log_stats(logs(spark, d))


@query(f"WITH {LOG} SELECT round(avg((level = 'error')::INT) * 100, 4) AS error_rate FROM log")
def error_rate(spark, d):
    return O.error_rate(logs(spark, d))


@query(f"WITH {LOG}, x AS (SELECT *, count(*) OVER () AS total FROM log WHERE stage = 'click' AND status = 'ok' AND lower(message) LIKE '%k\": 1%') SELECT event_id, ts, message, total, (total + 19) // 20 AS total_pages FROM x ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def log_search(spark, d):
    found = O.log_search(logs(spark, d), 'K": 1', "click", "ok")
    return O.newest_page(found, [F.desc("ts"), F.desc("event_id")], 2, 20).select("event_id", "ts", "message", "total", "total_pages")


@query("SELECT event_id // 1000 AS batch, count(*) AS docs, sum(length(props))::BIGINT AS bytes, round(sum(length(props)) / 1048576.0 / 2.5, 6) AS mb_per_second FROM events GROUP BY 1")
def batch_throughput(spark, d):
    from tidemark.operators.changelog import byte_rate

    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("batch")).agg(
        F.count("*").alias("docs"), F.sum(F.octet_length("props")).alias("bytes"), F.round(byte_rate(F.octet_length("props"), 2.5), 6).alias("mb_per_second"))


@query(f"WITH {LOG} SELECT event_id, correlation, row_number() OVER (PARTITION BY correlation ORDER BY ts, event_id) AS place FROM log")
def correlated(spark, d):
    place = F.row_number().over(W.partitionBy("correlation").orderBy("ts", "event_id"))
    return logs(spark, d).select("event_id", "correlation", place.alias("place"))
