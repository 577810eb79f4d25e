"""Queries on telemetry: events seen as observations of ten nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import telemetry as T, patterns as P
from tidemark.plans.registry import query
from tidemark.sources.storage import table


def tel(spark, d) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select((F.col("user_id") % 10).alias("node"), (v % 100).alias("cpu"), ((v * 3) % 100).alias("mem"), (v * 10).alias("latency"),
                                            (F.col("user_id") % 30).alias("conn"), "ts", F.col("event_id").alias("seq"), "event_type")


@query("""WITH $TEL, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) AS k FROM tel),
p AS (SELECT node, count(*) AS n, avg(cpu) AS mean_cpu, max(cpu) AS peak_cpu, avg(mem) AS mean_mem, max(mem) AS peak_mem, avg(latency) AS mean_latency, max(latency) AS peak_latency, var_pop(conn) / avg(conn) AS cv FROM r WHERE k <= 50 GROUP BY node)
SELECT node, n, round(mean_cpu, 9) AS mean_cpu, round(peak_cpu, 9) AS peak_cpu, round(mean_mem, 9) AS mean_mem, round(peak_mem, 9) AS peak_mem, round(mean_latency, 9) AS mean_latency, round(peak_latency, 9) AS peak_latency,
CASE WHEN n < 5 THEN 'unknown' WHEN cv < 0.2 THEN 'steady' WHEN cv > 0.8 THEN 'bursty' ELSE 'cyclical' END AS traffic,
CASE WHEN mean_cpu > 80 THEN 'cpu' WHEN mean_mem > 80 THEN 'memory' WHEN mean_latency > 5000 THEN 'network' ELSE 'balanced' END AS "constraint",
CASE WHEN mean_latency < 100 THEN 'oltp' WHEN mean_latency > 1000 THEN 'olap' ELSE 'mixed' END AS workload FROM p""")
def profile_env(spark, d):
    return T.environment(tel(spark, d))


@query("WITH $TEL SELECT node, count(*) AS n, CASE WHEN count(*) < 10 THEN 0.0 ELSE round(avg((event_type <> 'error')::INT) * least(1.0, count(*) / 100.0), 9) END AS confidence FROM tel GROUP BY node")
def profile_confidence(spark, d):
    return T.confidence(tel(spark, d), "node", F.col("event_type") != "error")


BAND = "CASE WHEN {0} < {1} THEN 0.5 + 0.5 * {0} / {1} WHEN {0} > {2} THEN greatest(0.1, 1 - ({0} - {2}) / (100 - {2})) ELSE 1.0 END"


@query(f"""WITH $TEL SELECT seq, round(least(1.0, greatest(0.0, 0.3 * ({BAND.format('cpu', '50.0', '70.0')} + {BAND.format('mem', '40.0', '60.0')}) / 2 + 0.4 * (1 - least(1.0, latency / 500)) + 0.2 * 0.5 + 0.1 * 0.5)), 9)::DOUBLE AS score FROM tel""")
def usage_score(spark, d):
    score = T.usage_score(F.col("cpu"), F.col("mem"), F.col("latency"), F.lit(0.5), F.lit(0.5))
    return tel(spark, d).select("seq", F.round(score, 9).alias("score"))


@query("""WITH $TEL, x AS (SELECT *, conn * 20 AS queue FROM tel) SELECT seq, cpu > 75 OR mem > 80 OR latency > 500 OR queue > 500 AS overloaded,
round(50 + 1950 * least(1.0, greatest(0.0, greatest((cpu - 75) / 25, (mem - 80) / 20, (latency - 500) / 500, (queue - 500) / 500))), 9) AS throttle_ms,
round(least(1.25, greatest(1.05, 1.05 + 0.2 * least(1 - cpu / 100, 1 - mem / 100))), 9) AS scale FROM x""")
def load_flags(spark, d):
    return T.load_flags(tel(spark, d).withColumn("queue", F.col("conn") * 20)).select("seq", "overloaded", "throttle_ms", "scale")


FOLD = """WITH RECURSIVE $TEL, o AS (SELECT {0}, {1} AS s, row_number() OVER (PARTITION BY {0} ORDER BY ts, seq) AS k FROM tel),
f AS (SELECT {0}, k, s AS v FROM o WHERE k = 1 UNION ALL SELECT o.{0}, o.k, {2} FROM f JOIN o ON o.{0} = f.{0} AND o.k = f.k + 1), u AS (SELECT {0}, count(*) AS n FROM tel GROUP BY {0}), e AS (SELECT {0}, arg_max(v, k) AS v, any_value(n) AS n FROM f JOIN u USING ({0}) GROUP BY {0})"""


@query(FOLD.format("conn", "mem / 100", "0.7 * f.v + 0.3 * o.s") + " SELECT conn, round(v, 9) AS effectiveness FROM e ORDER BY effectiveness DESC, conn LIMIT 5")
def top_patterns(spark, d):
    return T.effectiveness(tel(spark, d).withColumn("s", F.col("mem") / 100), ["conn"], "s", top=5).select("conn", "effectiveness")


def examples(spark, d, n: int = 500) -> DataFrame:
    """The newest n observations: the history that the recommendation keeps."""
    recent = tel(spark, d).orderBy(F.desc("ts"), F.desc("seq")).limit(n)
    return recent.select(F.col("seq").alias("qid"), "cpu", "mem", "latency", F.col("conn").cast("double").alias("conn"), (F.col("cpu") / 10 + 1).alias("setting"), (F.col("mem") / 100 + 0.01).alias("score"))


EX = "ex AS (SELECT seq AS qid, cpu, mem, latency, conn::DOUBLE AS conn, cpu / 10 + 1 AS setting, mem / 100 + 0.01 AS score FROM tel ORDER BY ts DESC, seq DESC LIMIT 500)"
KNN = """q AS (SELECT seq AS qid, cpu, mem, latency, conn::DOUBLE AS conn FROM tel), n AS (SELECT q.qid, e.qid AS eid, e.setting, e.score, round(sqrt(0.3 * (q.cpu - e.cpu) ** 2 + 0.25 * (q.mem - e.mem) ** 2 + 0.2 * (q.latency - e.latency) ** 2 + 0.1 * (q.conn - e.conn) ** 2), 9) AS distance
FROM q JOIN ex e ON q.qid <> e.qid), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, eid) AS k FROM n)"""


@query(f"WITH $TEL, {EX}, {KNN} SELECT qid, round(sum(setting * score) / sum(score), 9) AS setting, round(avg(distance), 9) AS mean_distance FROM k WHERE k <= 5 GROUP BY qid")
def knn_recommend(spark, d):
    """Every observation against the kept examples."""
    q = tel(spark, d).select(F.col("seq").alias("qid"), "cpu", "mem", "latency", F.col("conn").cast("double").alias("conn"))
    return T.neighbours(q, examples(spark, d))


@query(f"""WITH $TEL, {EX}, s AS (SELECT *, ntile(5) OVER (ORDER BY qid) AS part FROM ex), n AS (SELECT q.qid, q.setting AS want, e.qid AS eid, e.setting, round(sqrt(0.3 * (q.cpu - e.cpu) ** 2 + 0.25 * (q.mem - e.mem) ** 2 + 0.2 * (q.latency - e.latency) ** 2 + 0.1 * (q.conn - e.conn) ** 2), 9) AS distance
FROM s q JOIN s e ON q.part = 5 AND e.part < 5), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, eid) AS k FROM n), h AS (SELECT qid, abs(floor(sum(floor(setting)) / 3) - floor(any_value(want))) <= 1 AS hit FROM k WHERE k <= 3 GROUP BY qid)
SELECT count(*) AS n, round(avg(hit::INT), 9) AS accuracy FROM h""")
def knn_accuracy(spark, d):
    """The last fifth of the examples predicted from the rest: mean of three neighbours, in whole numbers, within one."""
    from pyspark.sql import Window as W

    e = examples(spark, d).withColumn("part", F.ntile(5).over(W.orderBy("qid")))  # at most 500 rows
    q, known = e.filter("part = 5"), e.filter("part < 5").select(*[F.col(c).alias(f"e_{c}") for c in ("qid", "cpu", "mem", "latency", "conn", "setting")])
    distance = F.round(F.sqrt(sum((w * F.pow(F.col(c) - F.col(f"e_{c}"), 2) for c, w in T.NEAR.items()), F.lit(0.0))), 9)
    near = T.last_n(q.crossJoin(F.broadcast(known)).withColumn("distance", distance), ["qid"], [F.asc("distance"), F.asc("e_qid")], 3)
    hit = F.abs(F.floor(F.sum(F.floor("e_setting")) / 3) - F.floor(F.first("setting"))) <= 1
    return near.groupBy("qid").agg(hit.alias("hit")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("accuracy"))


PATTERNS = [(f"p{i}", 10.0 * i, 10.0 * i + 25, 8.0 * i, 8.0 * i + 30, 60.0 * i, 60.0 * i + 200, ("morning", "afternoon", "evening", "night")[i % 4], ("weekday", "weekend")[i % 2], ("low", "medium", "high")[i % 3]) for i in range(10)]


def _overlap(a1, a2, b1, b2):
    a1, a2 = f"({a1})", f"({a2})"
    return f"CASE WHEN least({a2} - {a1}, {b2} - {b1}) > 0 THEN greatest(0.0, least({a2}, {b2}) - greatest({a1}, {b1})) / least({a2} - {a1}, {b2} - {b1}) ELSE ({a1} <= {b2} AND {b1} <= {a2})::INT END"


@query(f"""WITH $TEL, v(name, c1, c2, m1, m2, l1, l2, slot, day, volume) AS (VALUES {', '.join(map(str, PATTERNS))}), p AS (SELECT name, slot, day, volume, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('c1', 'c2', 'm1', 'm2', 'l1', 'l2'))} FROM v), s AS (SELECT seq, name,
0.3 * {_overlap('cpu - 5', 'cpu + 5', 'c1', 'c2')} + 0.25 * {_overlap('mem - 5', 'mem + 5', 'm1', 'm2')} + 0.2 * {_overlap('latency - 50', 'latency + 50', 'l1', 'l2')}
+ 0.1 * (slot = CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END)::INT
+ 0.05 * (day = CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END)::INT + 0.1 * (volume = CASE WHEN conn < 5 THEN 'low' WHEN conn > 20 THEN 'high' ELSE 'medium' END)::INT AS score FROM tel, p)
SELECT seq, arg_max(name, (round(score, 9), name)) AS name, max(round(score, 9)) AS score FROM s WHERE round(score, 9) > 0.7 GROUP BY seq""")
def best_pattern(spark, d):
    from tidemark.functions.columns import day_kind, time_of_day, volume_class

    p = F.broadcast(spark.createDataFrame(PATTERNS, "name string, c1 double, c2 double, m1 double, m2 double, l1 double, l2 double, slot string, day string, volume string"))
    part = {"cpu": T.overlap(F.col("cpu") - 5, F.col("cpu") + 5, F.col("c1"), F.col("c2")), "mem": T.overlap(F.col("mem") - 5, F.col("mem") + 5, F.col("m1"), F.col("m2")),
            "latency": T.overlap(F.col("latency") - 50, F.col("latency") + 50, F.col("l1"), F.col("l2")), "slot": (F.col("slot") == time_of_day(F.col("ts"))).cast("int"),
            "day": (F.col("day") == day_kind(F.col("ts"))).cast("int"), "volume": (F.col("volume") == volume_class(F.col("conn"))).cast("int")}
    score = F.round(sum((w * part[k] for k, w in T.MATCH.items()), F.lit(0.0)), 9)
    s = tel(spark, d).crossJoin(p).withColumn("score", score).filter("score > 0.7")  # ten patterns, a fixed list
    return s.groupBy("seq").agg(F.max_by("name", F.struct("score", "name")).alias("name"), F.max("score").alias("score"))


BUCKETS = """WITH RECURSIVE $TEL, q AS (SELECT """ + ", ".join(f"quantile_cont(round({c}, 2), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q_{c}" for c in ("cpu", "mem", "latency")) + """ FROM tel),
w AS (SELECT tel.*, """ + ", ".join(f"len(list_filter(q_{c}, lambda x: round({c}, 2) > round(x, 6))) AS d_{c}" for c in ("cpu", "mem", "latency")) + """,
  CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS slot,
  CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS dk, CASE WHEN conn < 5 THEN 'low' WHEN conn > 20 THEN 'high' ELSE 'medium' END AS volume FROM tel, q),
y AS (SELECT *, d_cpu || '/' || d_mem || '/' || d_latency || '/' || slot || '/' || dk || '/' || volume AS bucket FROM w),
k AS (SELECT bucket, d_cpu, d_mem, slot, dk, volume, min(cpu) AS c1, max(cpu) AS c2, min(mem) AS m1, max(mem) AS m2, min(latency) AS l1, max(latency) AS l2 FROM y GROUP BY ALL),
pr AS (SELECT a.bucket AS a, b.bucket AS b FROM k a JOIN k b ON a.bucket <> b.bucket AND round(""" + " + ".join(
    f"{w} * {_overlap(f'a.{c}1', f'a.{c}2', f'b.{c}1', f'b.{c}2')}" for c, w in (("c", 0.3), ("m", 0.25), ("l", 0.2))) + """ + 0.1 * (a.slot = b.slot)::INT + 0.05 * (a.dk = b.dk)::INT + 0.1 * (a.volume = b.volume)::INT, 9) >= 0.8),
reach AS (SELECT a, b FROM pr UNION SELECT reach.a, pr.b FROM reach JOIN pr ON pr.a = reach.b),
pat AS (SELECT a AS bucket, least(a, min(b)) AS pattern FROM reach GROUP BY a),
o AS (SELECT coalesce(pattern, bucket) AS pattern, cpu / 100 AS s, row_number() OVER (PARTITION BY coalesce(pattern, bucket) ORDER BY ts, seq) AS k FROM y LEFT JOIN pat USING (bucket)),
f AS (SELECT pattern, k, s AS v FROM o WHERE k = 1 UNION ALL SELECT o.pattern, o.k, 0.7 * f.v + 0.3 * o.s FROM f JOIN o ON o.pattern = f.pattern AND o.k = f.k + 1)
SELECT pattern, round(arg_max(v, k), 9) AS effectiveness, max(k) AS uses, round(least(1.0, 0.1 * max(k)), 9)::DOUBLE AS confidence FROM f GROUP BY pattern ORDER BY effectiveness DESC, pattern LIMIT 20"""


@query(BUCKETS)
def pattern_effectiveness(spark, d):
    """By pattern: buckets of conditions, joined where they match by 0.8 or more."""
    return T.effectiveness(P.with_pattern(tel(spark, d).withColumn("s", F.col("cpu") / 100)), ["pattern"], "s")


@query("""WITH $TEL, x AS (SELECT *, avg(cpu) OVER w AS m_cpu, avg(mem) OVER w AS m_mem, avg(latency) OVER w AS m_latency, last(cpu) OVER w - first(cpu) OVER w AS d_cpu, last(mem) OVER w - first(mem) OVER w AS d_mem, last(latency) OVER w - first(latency) OVER w AS d_latency
FROM tel WINDOW w AS (PARTITION BY node ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT seq, round(m_cpu, 9) AS m_cpu, round(d_cpu, 9) AS d_cpu, CASE WHEN m_cpu > 80 AND d_cpu > 0 THEN 'shrink' WHEN m_mem > 85 AND d_mem > 0 THEN 'smaller_batch' WHEN m_latency > 5000 AND d_latency > 0 THEN 'back_pressure' WHEN m_cpu < 30 AND m_mem < 50 AND m_latency < 1000 THEN 'grow' ELSE 'keep' END AS action FROM x""")
def trend3(spark, d):
    return T.trend3(tel(spark, d)).select("seq", F.round("m_cpu", 9).alias("m_cpu"), F.round("d_cpu", 9).alias("d_cpu"), "action")


@query("""WITH $TEL, x AS (SELECT seq, cpu, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h, cpu - lag(cpu) OVER w AS dv, row_number() OVER w AS n FROM tel WINDOW w AS (PARTITION BY node ORDER BY ts, seq)), r AS (SELECT *, CASE WHEN h > 0 THEN dv / h END AS rate FROM x)
SELECT seq, CASE WHEN rate IS NULL THEN 'none' WHEN abs(rate) < 0.1 THEN 'stable' WHEN rate > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(least(10, n - 1) / 10.0, 1)::DOUBLE AS confidence, least(10, n - 1) > 7 AND coalesce(abs(rate) > 5, false) AS flag FROM r""")
def metric_trend(spark, d):
    t = T.metric_trend(tel(spark, d), ["node"], "cpu")
    return t.select("seq", "direction", F.round(F.col("tenths") / 10, 1).alias("confidence"), "flag")


@query("""WITH $TEL, x AS (SELECT seq, event_type, latency, count(*) OVER w AS n, avg(latency) OVER w AS mean, stddev_pop(latency) OVER w AS sd FROM tel WINDOW w AS (PARTITION BY event_type ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, event_type, round(mean, 9) AS mean, n FROM x WHERE n >= 10 AND abs(latency - mean) > 2 * sd""")
def anomaly(spark, d):
    return T.anomalies(tel(spark, d), ["event_type"], "latency").filter("anomaly").select("seq", "event_type", F.round("mean", 9).alias("mean"), "n")


@query("WITH $TEL SELECT seq, conn - coalesce(lag(conn) OVER (PARTITION BY node ORDER BY ts, seq), 0) AS delta FROM tel")
def deltas(spark, d):
    return T.deltas(tel(spark, d), ["node"], "conn").select("seq", "delta")


@query(FOLD.format("node", "latency", "(f.v + o.s) / 2") + " SELECT node, round(v, 9) AS half_mean FROM e")
def half_mean(spark, d):
    return T.half_mean(tel(spark, d), ["node"], "latency")


@query("WITH $TEL SELECT seq, greatest(0.1, 1 - count(*) OVER (PARTITION BY node ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) / 10) AS stability FROM tel")
def stability(spark, d):
    return T.stability(tel(spark, d), ["node"]).select("seq", "stability")


@query("WITH $TEL SELECT seq, round(CASE WHEN count(*) OVER w < 3 THEN 0.5 ELSE avg(cpu / 100) OVER w END, 9) AS trend_score FROM tel WINDOW w AS (PARTITION BY node ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def trend_score(spark, d):
    return T.trend_score(tel(spark, d).withColumn("s", F.col("cpu") / 100), ["node"], "s").select("seq", F.round("trend_score", 9).alias("trend_score"))


@query("WITH $TEL SELECT node, strftime(ts, '%H:00') AS slot, bool_or(cpu > 70) AS peak, bool_or(cpu < 30) AS low, round(least(1.0, count(*) / 100.0), 9)::DOUBLE AS confidence FROM tel GROUP BY ALL")
def seasonal_slots(spark, d):
    return T.seasons(tel(spark, d), ["node"])


LOAD = "0.4 * avg(cpu) / 100 + 0.3 * avg(mem) / 100 + 0.2 * least(1.0, avg(conn) / 30) + 0.1 * least(1.0, count(*) FILTER (event_type = 'error') / 100.0)"


@query(f"WITH $TEL, l AS (SELECT node, round({LOAD}, 9) AS load FROM tel GROUP BY node) SELECT node, load, rank() OVER (ORDER BY load) AS place FROM l")
def node_rank(spark, d):
    from pyspark.sql import Window as W

    bad = F.count_if(F.col("event_type") == "error").cast("double")
    load = T.node_load(F.avg("cpu"), F.avg("mem"), F.avg("conn"), F.lit(30.0), bad)
    nodes = tel(spark, d).groupBy("node").agg(F.round(load, 9).alias("load"))
    return nodes.withColumn("place", F.rank().over(W.orderBy("load")))  # one row per node


@query("""WITH $TEL, n AS (SELECT node, count(*) FILTER (conn < 15) AS free, count(*) AS most, node % 2 = 0 AS tcp, node + 1 AS gb, node * 3 AS concurrency,
  CASE WHEN node % 3 = 0 THEN ['bank'] WHEN node % 3 = 1 THEN ['shop', 'bank'] ELSE [] END AS preferred, CASE WHEN node % 4 = 1 THEN ['shop'] WHEN node % 4 = 2 THEN ['bank', 'logs'] WHEN node % 3 = 2 THEN ['logs'] ELSE [] END AS excluded FROM tel GROUP BY node),
t(name, db, mb) AS (VALUES ('small', 'shop', 10.0), ('large', 'bank', 5000.0), ('odd', 'logs', 2000.0)),
x AS (SELECT *, NOT list_contains(excluded, db) AND (len(preferred) = 0 OR list_contains(preferred, db)) AS fits, round(50.0 * greatest(free, 0) / most + CASE WHEN mb > 1000 AND tcp THEN 20 ELSE 0 END + 5 * gb + 2 * concurrency, 9) AS score FROM n, t),
y AS (SELECT *, bool_or(fits) OVER (PARTITION BY name) AS anyfit FROM x)
SELECT name, node, score, rank() OVER (PARTITION BY name ORDER BY score DESC) AS place FROM y WHERE fits OR NOT anyfit""")
def capability_rank(spark, d):
    """Nodes for each table: those that don't exclude its database and prefer it or have no preference; where there are none, all."""
    n = tel(spark, d).groupBy("node").agg(F.count_if(F.col("conn") < 15).alias("free"), F.count("*").alias("most"))
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    three, four = F.col("node") % 3, F.col("node") % 4
    n = n.withColumns({"preferred": F.when(three == 0, names("bank")).when(three == 1, names("shop", "bank")).otherwise(names()),
                       "excluded": F.when(four == 1, names("shop")).when(four == 2, names("bank", "logs")).when(three == 2, names("logs")).otherwise(names())})
    t = spark.createDataFrame([("small", "shop", 10.0), ("large", "bank", 5000.0), ("odd", "logs", 2000.0)], "name string, db string, mb double")
    score = F.round(T.capability(F.col("mb"), F.col("free"), F.col("most"), F.col("node") % 2 == 0, F.col("node") + 1, F.col("node") * 3), 9)
    return T.ranked(T.eligible(n, t).withColumn("score", score), ["name"], "score").select("name", "node", "score", "place")


@query("WITH $TEL, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) AS k FROM tel) SELECT node, seq FROM r WHERE k <= 50")
def history_cap(spark, d):
    return T.last_n(tel(spark, d), ["node"], [F.desc("ts"), F.desc("seq")], 50).select("node", "seq")


@query("""WITH $TEL, a AS (SELECT DISTINCT node, conn FROM tel), h AS (SELECT node, avg(cpu) < 90 AS healthy FROM tel GROUP BY node)
SELECT h.node, healthy, count(DISTINCT conn) AS assigned, round(count(DISTINCT conn) * 100.0 / (SELECT count(*) FROM a), 9)::DOUBLE AS load_percent FROM h JOIN a ON a.node = h.node GROUP BY h.node, healthy""")
def assignment_status(spark, d):
    t = tel(spark, d)
    per = t.groupBy("node").agg((F.avg("cpu") < 90).alias("healthy"), F.count_distinct("conn").alias("assigned"))
    total = per.agg(F.sum("assigned").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("node", "healthy", "assigned", F.round(F.col("assigned") * 100 / F.col("t"), 9).alias("load_percent"))
