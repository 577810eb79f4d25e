"""Queries on row filters, column filters and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import host_rewrite, protect, reveal
from tidemark.functions.predicates import column_filter, row_filter
from tidemark.operators import enrich, snapshot as S
from tidemark.operators.pages import KeysetPages
from tidemark.plans.registry import query
from tidemark.plans.spec import TableSpec
from tidemark.sources.storage import scratch, table

ORDERS = TableSpec("shop", "orders", target_db="shop_copy", criteria=({"field": "o_orderstatus", "operator": "ne", "value": "P"}, {"field": "o_totalprice", "operator": "gt", "value": 1000}),
                   include=("o_custkey", "o_totalprice", "o_orderstatus"), key="o_orderkey")


def _orders(spark, d, *criteria, missing="pass"):
    """Orders with missing values: urgent orders lack a status."""
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus")))
    return o.filter(row_filter(o, criteria, missing=missing)).select("o_orderkey", "o_orderstatus")


WITH_MISSING = "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority, o_custkey FROM orders) SELECT o_orderkey, o_orderstatus FROM o WHERE "


@query(WITH_MISSING + "o_orderstatus IS NOT DISTINCT FROM 'F'")
def filter_eq(spark, d):
    return _orders(spark, d, {"field": "o_orderstatus", "operator": "EQ", "value": "F"})


@query(WITH_MISSING + "o_orderstatus IS DISTINCT FROM 'F'")
def filter_ne_missing(spark, d):
    return _orders(spark, d, {"field": "o_orderstatus", "operator": "ne", "value": "F"})


@query(WITH_MISSING + "o_orderstatus IN ('F', 'P')")
def filter_in(spark, d):
    return _orders(spark, d, {"field": "o_orderstatus", "operator": "in", "value": ["F", "P"]})


@query(WITH_MISSING + "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'P')")
def filter_nin(spark, d):
    return _orders(spark, d, {"field": "o_orderstatus", "operator": "nin", "value": ["F", "P"]})


@query(WITH_MISSING + "o_totalprice >= 1000 AND o_totalprice < 200000 AND o_custkey > 5 AND o_custkey <= 900")
def filter_range(spark, d):
    return _orders(spark, d, *({"field": f, "operator": o, "value": v} for f, o, v in (("o_totalprice", "gte", 1000), ("o_totalprice", "lt", 200000), ("o_custkey", "gt", 5), ("o_custkey", "lte", 900))))


@query(WITH_MISSING + "regexp_matches(o_orderpriority, '^[1-3]-')")
def filter_regex(spark, d):
    return _orders(spark, d, {"field": "o_orderpriority", "operator": "regex", "value": "^[1-3]-"})


@query(WITH_MISSING + "o_orderstatus = 'O'")
def filter_default_eq(spark, d):
    return _orders(spark, d, {"field": "o_orderstatus", "operator": "no-such-operator", "value": "O"})


@query(WITH_MISSING + "o_totalprice > 5000")
def filter_empty_list(spark, d):
    return _orders(spark, d, {"field": "o_orderstatus", "operator": "in", "value": []}, {"field": "o_orderstatus", "operator": "nin", "value": []}, {"field": "o_totalprice", "operator": "gt", "value": 5000})


@query(WITH_MISSING + "o_orderstatus IS NOT NULL AND o_orderstatus <> 'F' AND o_totalprice::VARCHAR > '5'")
def filter_strict_missing(spark, d):
    """Unlike types compare as strings."""
    o = table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).withColumn("o_orderstatus", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus")))
    return o.filter(row_filter(o, [{"field": "o_orderstatus", "operator": "ne", "value": "F"}, {"field": "o_totalprice", "operator": "gt", "value": 5}], missing="reject")).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def fields_include(spark, d):
    return column_filter(table(spark, d, "customer"), "c_custkey", include=["c_name", "c_acctbal", "no_such_column"])


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def fields_exclude(spark, d):
    return column_filter(table(spark, d, "customer"), "c_custkey", exclude=["c_acctbal", "c_custkey"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def fields_always(spark, d):
    return column_filter(table(spark, d, "customer"), "c_custkey", include=["c_name"], exclude=["c_name"], always=["c_mktsegment"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'shop' AS db, 'shop_copy' AS target_db FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' AND o_totalprice > 1000")
def snapshot_orders(spark, d):
    rows = S.snapshot(table(spark, d, "orders"), ORDERS).withColumn("db", F.lit(ORDERS.db))
    return S.route(rows, spark.createDataFrame([(ORDERS.db, ORDERS.target_db)], "db string, target_db string"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' AND o_totalprice > 1000")
def snapshot_count(spark, d):
    return S.count_only(table(spark, d, "orders"), ORDERS)


@query("SELECT * FROM orders WHERE o_orderkey > 700")
def snapshot_keyset(spark, d):
    return S.keyset(table(spark, d, "orders"), "o_orderkey", 700)


@query("SELECT o_orderkey, o_totalprice, count(*) OVER () AS pushed FROM orders WHERE o_orderkey > 700")
def snapshot_keyset_pages(spark, d):
    """Orders past a key in twelve pages or so; the copy stops after the fifth, and a new one resumes behind its last key."""
    o, to, progress = table(spark, d, "orders"), scratch(spark), scratch(spark)
    size = max(1, o.filter("o_orderkey > 700").count() // 12)

    def sink(rows, page, most=None):
        if page == most:
            raise TimeoutError("stopped")
        rows.select("o_orderkey", "o_totalprice").write.parquet(f"{to}/page={page}", mode="overwrite")
        return spark.read.schema("o_orderkey long, o_totalprice double").parquet(f"{to}/page={page}").count()

    try:
        KeysetPages(o, "o_orderkey", size, progress, 700).push(lambda rows, page: sink(rows, page, 5))
    except TimeoutError:
        pass
    pushed = KeysetPages(o, "o_orderkey", size, progress, 700).push(sink)
    return spark.read.schema("o_orderkey long, o_totalprice double").parquet(f"{to}/*").withColumn("pushed", F.lit(pushed).cast("long"))


SLICED = """WITH p AS (SELECT greatest(1, least(50, count(*) // 10000)) AS n, greatest(1, count(*) // greatest(1, least(50, count(*) // 10000))) AS step, count(*) AS c FROM orders),
s AS (SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1) // step, n - 1)::INT AS slice, n, step, c FROM orders, p)"""


@query(SLICED + """, m AS (SELECT slice, max(o_orderkey) AS k, count(*) AS cnt, any_value(n) AS n, any_value(step) AS step, any_value(c) AS c FROM s GROUP BY slice)
SELECT a.slice, a.n::INT AS total, b.k AS low, CASE WHEN a.slice < a.n - 1 THEN a.k END AS high, CASE WHEN a.slice = a.n - 1 THEN a.c - a.step * (a.n - 1) ELSE a.step END AS est_count, a.cnt AS n
FROM m a LEFT JOIN m b ON b.slice = a.slice - 1""")
def snapshot_bounds(spark, d):
    return S.bounds(table(spark, d, "orders"), "o_orderkey")


@query(SLICED + "SELECT slice, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM s GROUP BY slice")
def snapshot_slice_counts(spark, d):
    return S.slices(table(spark, d, "orders"), "o_orderkey").groupBy("slice").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("""WITH t AS (SELECT greatest(1, ceil(count(*) / 1000.0))::BIGINT AS total_pages FROM orders)
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page, total_pages, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 < total_pages - 1 AS has_next,
       (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 > 0 AS has_prev FROM orders, t""")
def snapshot_page(spark, d):
    return S.paged(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT c_mktsegment AS db, CASE c_mktsegment WHEN 'BUILDING' THEN 'b_copy' WHEN 'MACHINERY' THEN 'm_copy' ELSE c_mktsegment END AS target_db, count(*) AS n FROM customer GROUP BY ALL")
def route_tables(spark, d):
    routes = spark.createDataFrame([("BUILDING", "b_copy"), ("MACHINERY", "m_copy")], "db string, target_db string")
    return S.route(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "db"), routes).groupBy("db", "target_db").agg(F.count("*").alias("n"))


@query("WITH $CH SELECT db, coll, op, doc_key, seq FROM ch WHERE coll = 'c1'")
def authorised_only(spark, d):
    from tidemark.sources.changes import as_changes

    tables = spark.createDataFrame([("shop", "c1", True), ("shop", "c2", False)], "db string, coll string, enabled boolean")
    return S.authorised(as_changes(table(spark, d, "events")), tables).select("db", "coll", "op", "doc_key", "seq")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def semi_join_keys(spark, d):
    allowed = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return enrich.authorised_keys(table(spark, d, "orders"), allowed, F.col("c_acctbal") > 0, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(r"SELECT page_id, regexp_replace(url, '^(https?://)[^/]+(/.*)?$', '\1new.example\2') AS url FROM pages")
def url_rewrite(spark, d):
    return table(spark, d, "pages").select("page_id", host_rewrite(F.col("url"), "new.example").alias("url"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def protect_roundtrip(spark, d):
    key = "0123456789abcdef"
    return reveal(protect(table(spark, d, "customer"), ["c_name", "c_acctbal"], key, "k1", ["c_custkey"]), "c_name string, c_acctbal double", key)


@query("""WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), c AS (SELECT b, count(*) AS n FROM b GROUP BY b), t AS (SELECT sum(n) AS t FROM c)
SELECT any_value(t)::BIGINT AS bytes, round(-sum(n / t * log2(n / t)), 4) AS entropy, round(0.3 + 0.4 * -sum(n / t * log2(n / t)) / 8, 4) AS zstd_ratio, round(0.5 + 0.3 * -sum(n / t * log2(n / t)) / 8, 4) AS lz4_ratio FROM c, t""")
def entropy_profile(spark, d):
    return enrich.entropy(table(spark, d, "documents"), F.col("text"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 IN (1, 3) AND o_orderkey % 7 <> 2")
def filter_object_ids(spark, d):
    """Ids of 12 bytes, named in the criteria by their 24 hexadecimal digits, in either case; the last one is no id and stays a string."""
    oid = lambda n: F.unhex(F.lpad(F.hex(n), 24, "0"))
    o = table(spark, d, "orders").withColumns({"_id": oid(F.col("o_orderkey") % 5), "doc": F.struct(oid(F.col("o_orderkey") % 7).alias("_id"))})
    criteria = [{"field": "_id", "operator": "in", "value": ["0" * 23 + "1", "0" * 23 + "3", "0" * 22 + "aF"]}, {"field": "doc._id", "operator": "ne", "value": "0" * 23 + "2"}, {"field": "doc._id", "operator": "ne", "value": "xyz"}]
    return o.filter(row_filter(o, criteria)).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' AND o_totalprice > 1000")
def mapped_copy(spark, d):
    """Written under the target's name, then read back."""
    to = f"{scratch(spark)}/{S.target_name(ORDERS)}.orders"
    S.snapshot(table(spark, d, "orders"), ORDERS).write.parquet(to)
    return spark.read.parquet(to)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def fixed_keys(spark, d):
    spec = TableSpec("shop", "part", criteria=({"field": "p_brand", "operator": "in", "value": ["Brand#1", "Brand#2"]},), include=("p_name", "p_brand"), key="p_partkey")
    return S.snapshot(table(spark, d, "part"), spec)


@query("""SELECT * FROM (SELECT 1 AS place, 'sales.orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 2, 'sales.lineitem', count(*) FROM lineitem UNION ALL SELECT 3, 'crm.customer', count(*) FROM customer)""")
def table_order(spark, d):
    """Tables of a spec by priority, each with its count."""
    from tidemark.plans.spec import SyncSpec

    spec = SyncSpec((TableSpec("crm", "customer", db_priority=2), TableSpec("sales", "lineitem", db_priority=1, priority=2), TableSpec("sales", "orders", db_priority=1, priority=1), TableSpec("sales", "part", enabled=False)))
    parts = [table(spark, d, t.coll).agg(F.count("*").alias("n")).select(F.lit(i).alias("place"), F.lit(t.name).alias("name"), "n") for i, t in enumerate(spec.select(), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CODED = ("region", "nation", "supplier", "customer", "orders")


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, sum(length(to_json(x)))::BIGINT AS b FROM {t} x" for t in CODED) + """)
SELECT t, n, CASE WHEN b < 1024 THEN 'none' WHEN b < 102400 THEN 'lz4' ELSE 'zstd' END AS codec FROM s""")
def codec_choice(spark, d):
    """Each table is written with the codec of its measured size; the codec is read off the files."""
    out = None
    for name in CODED:
        to = scratch(spark)
        S.write_by_size(table(spark, d, name), to)
        files = spark.read.parquet(to).select(F.lower("_metadata.file_name").alias("f"))
        codec = F.when(F.col("f").contains("zstd"), "zstd").when(F.col("f").contains("lz4"), "lz4").when(F.regexp_like("f", F.lit(r"c000\.parquet$")), "none").otherwise("other")
        one = files.groupBy(codec.alias("codec")).agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n", "codec")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, round(avg(c_acctbal), 2) AS mean FROM customer")
def table_summary(spark, d):
    return enrich.summary(table(spark, d, "customer"), {"positive": F.col("c_acctbal") > 0, "building": F.col("c_mktsegment") == "BUILDING"}, "c_acctbal")
