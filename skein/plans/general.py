"""Queries of the general problems 1 to 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hot_keys import dominant_keys, salted_totals
from skein.operators.references import Reference, dangling_feedback, orphan_references
from skein.operators.sessions import sessionize
from skein.plans.tables import table

HOT_SHARE = 1 / 50


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(table(spark, d, "feedback")).select(F.col("key_id").alias("user_id"), "start_us", "end_us")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessionize(table(spark, d, "feedback"))
    return s.select(F.col("key_id").alias("user_id"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")


def p1_device_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same operator over another table: events, whose users are numbers, with a gap of a day."""
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("device"), "ts")
    return sessionize(events, "device", "ts", 86_400_000_000).select("key_id", "start_us", "end_us", "n_events")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_keys(table(spark, d, "feedback"), ["item_id", "user_id"], HOT_SHARE)


def _totals(spark: SparkSession, d: str, key: str) -> DataFrame:
    return salted_totals(table(spark, d, "feedback"), key).select("key_id", "n_rows", F.round("sum_value", 2).alias("sum_value"), "last_us")


def p2_item_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d, "item_id")


def p2_user_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d, "user_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dangling_feedback(*[table(spark, d, t) for t in ("feedback", "items", "users", "removals")])


def p3_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose (item, user), either of which may be null, was never seen in feedback, by month."""
    documents = table(spark, d, "documents")
    ref = Reference("feedback", ("item_id", "user_id"), table(spark, d, "feedback"), ("item_id", "user_id"), "partial")
    month = F.coalesce(F.date_format("review_date", "yyyy-MM"), F.lit("unknown"))
    return orphan_references(documents, ref, month).drop("late")


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p1_device_sessions, p2_found, p2_item_totals, p2_user_totals, p3_found, p3_reviews)}


def _sessions_sql(source: str, gap: int, columns: str) -> str:
    return f"""
WITH e AS ({source}),
l AS (SELECT k, t, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t) <= {gap} THEN 0 ELSE 1 END AS b FROM e),
g AS (SELECT k, t, sum(b) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT {columns} FROM g GROUP BY k, s"""


_FEEDBACK = "SELECT trim(user_id) AS k, epoch_us(timestamp) AS t FROM feedback WHERE trim(user_id) <> '' AND timestamp IS NOT NULL"


def _totals_sql(key: str) -> str:
    return f"""
SELECT trim({key}) AS key_id, count(*) AS n_rows, round(sum(CASE WHEN isnan(value) THEN NULL ELSE value END), 2) AS sum_value,
       max(epoch_us(timestamp)) AS last_us
FROM feedback WHERE trim({key}) <> '' GROUP BY 1"""


def _absent_sql(table_: str, entity: str, key: str) -> str:
    return f"""
SELECT DISTINCT '{table_}' AS ref_table, trim(f.{key}) AS ref_id, coalesce(strftime(f.timestamp, '%Y-%m-%d'), 'unknown') AS period,
       CASE WHEN trim(f.{key}) IN (SELECT trim(entity_id) FROM removals WHERE entity = '{entity}' AND entity_id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS kind
FROM feedback f WHERE trim(f.{key}) <> '' AND trim(f.{key}) NOT IN (SELECT trim({key}) FROM {table_} WHERE {key} IS NOT NULL)"""


SQL = {
    "p1_found": _sessions_sql(_FEEDBACK, 1_800_000_000, "k AS user_id, min(t) AS start_us, max(t) AS end_us"),
    "p1_sessions": _sessions_sql(_FEEDBACK, 1_800_000_000, "k AS user_id, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS n_events"),
    "p1_device_sessions": _sessions_sql("SELECT CAST(user_id AS VARCHAR) AS k, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL", 86_400_000_000, "k AS key_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events"),
    "p2_found": """
SELECT field, key_id FROM (
  SELECT 'item_id' AS field, trim(item_id) AS key_id FROM feedback UNION ALL SELECT 'user_id', trim(user_id) FROM feedback)
WHERE key_id <> '' GROUP BY field, key_id HAVING count(*) * 50 >= (SELECT count(*) FROM feedback)""",
    "p2_item_totals": _totals_sql("item_id"),
    "p2_user_totals": _totals_sql("user_id"),
    "p3_found": f"""{_absent_sql('items', 'item', 'item_id')}
UNION ALL {_absent_sql('users', 'user', 'user_id')}
UNION ALL
SELECT DISTINCT 'items', trim(f.item_id), strftime(f.timestamp, '%Y-%m-%d'), 'late'
FROM feedback f JOIN (SELECT trim(item_id) AS i, min(timestamp) AS since FROM items GROUP BY 1) s ON trim(f.item_id) = s.i
WHERE trim(f.item_id) <> '' AND s.since > f.timestamp""",
    "p3_reviews": """
WITH r AS (SELECT nullif(trim(item_id), '') AS key_1, nullif(trim(user_id), '') AS key_2, coalesce(strftime(review_date, '%Y-%m'), 'unknown') AS period, count(*) AS n_rows
           FROM documents GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT nullif(trim(item_id), '') AS i, nullif(trim(user_id), '') AS u FROM feedback)
SELECT 'feedback' AS ref_table, CASE WHEN key_1 IS NULL THEN '0' ELSE '1' END || CASE WHEN key_2 IS NULL THEN '0' ELSE '1' END AS mask, key_1, key_2, period, n_rows
FROM r WHERE (key_1 IS NOT NULL OR key_2 IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM f WHERE (key_1 IS NULL OR f.i = key_1) AND (key_2 IS NULL OR f.u = key_2))""",
}
