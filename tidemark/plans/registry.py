"""Named queries: each runs one operator over its whole tables; most have SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CH = """ch AS (SELECT 'shop' AS db, 'c' || (user_id % 3) AS coll, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  user_id AS doc_key, value, props, ts AS cluster_time, event_id AS seq, event_type FROM events)"""
TEL = "tel AS (SELECT user_id % 10 AS node, value % 100 AS cpu, (value * 3) % 100 AS mem, value * 10 AS latency, user_id % 30 AS conn, ts, event_id AS seq, event_type FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$CH", CH).replace("$TEL", TEL)
        return f

    return add
