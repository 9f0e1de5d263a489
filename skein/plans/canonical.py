"""Canonical tables of a data folder and their SQL, shared by all queries of the reference's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ingest import merge_feedback
from skein.operators.interactions import classify, clean_items, clean_users, positives
from skein.plans.tables import table

AS_OF = "2014-02-10 00:00:00"


def users(s: SparkSession, d: str) -> DataFrame:
    return clean_users(table(s, d, "users"))


def items(s: SparkSession, d: str) -> DataFrame:
    return clean_items(table(s, d, "items"))


def merged(s: SparkSession, d: str) -> DataFrame:
    return merge_feedback(table(s, d, "feedback"))


def classified(s: SparkSession, d: str) -> DataFrame:
    return classify(merged(s, d), users(s, d), items(s, d), AS_OF)


def liked(s: SparkSession, d: str) -> DataFrame:
    return positives(classified(s, d))


def item_tags(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select(F.col("item_id").alias("id"), F.explode("tags").alias("token"))


_TERMS = "list_sort(list_distinct(list_filter(list_transform(coalesce({}, []), lambda x: trim(lower(x))), lambda x: x IS NOT NULL AND x <> '')))"

CTE = {
    "u": """u AS (SELECT user_id, comment FROM (
        SELECT trim(user_id) AS user_id, max(nullif(comment, '')) AS comment FROM users WHERE trim(user_id) <> '' GROUP BY 1))""",
    "i": f"""i AS (SELECT * EXCLUDE (rn) FROM (
        SELECT trim(item_id) AS item_id, coalesce(is_hidden, false) AS is_hidden, {_TERMS.format('categories')} AS categories, timestamp, {_TERMS.format('labels.tags')} AS tags,
               labels.brand AS brand, labels."type" AS type, labels.price AS price, nullif(comment, '') AS comment,
               row_number() OVER (PARTITION BY trim(item_id) ORDER BY timestamp DESC NULLS LAST, coalesce(is_hidden, false) DESC, labels.price DESC NULLS LAST, labels.brand DESC NULLS LAST, labels."type" DESC NULLS LAST) AS rn
        FROM items WHERE trim(item_id) <> '') WHERE rn = 1)""",
    "m": """m AS (SELECT lower(trim(feedback_type)) AS feedback_type, trim(user_id) AS user_id, trim(item_id) AS item_id,
        coalesce(round(sum(CASE WHEN isnan(value) THEN NULL ELSE value END), 6), 0) AS value, min(timestamp) AS timestamp, max(updated) AS updated
        FROM feedback WHERE trim(feedback_type) <> '' AND trim(user_id) <> '' AND trim(item_id) <> '' GROUP BY 1, 2, 3)""",
    "c": f"""c0 AS (SELECT *, feedback_type = 'skip' AS neg, feedback_type IN ('purchase', 'like', 'share') OR (feedback_type = 'star' AND value >= 3) AS pos, feedback_type IN ('view', 'click') AS rd
        FROM m WHERE timestamp <= TIMESTAMP '{AS_OF}'),
    c1 AS (SELECT user_id, item_id, bool_or(neg) AS neg, bool_or(pos) AS pos, max(timestamp) AS timestamp, CAST(count(*) FILTER (WHERE pos) AS BIGINT) AS n_positive FROM c0 WHERE neg OR pos OR rd GROUP BY 1, 2),
    c AS (SELECT user_id, item_id, CASE WHEN neg THEN 'negative' WHEN pos THEN 'positive' ELSE 'read' END AS kind, timestamp, n_positive FROM c1
        WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i))""",
    "p": "p AS (SELECT * FROM c WHERE kind = 'positive')",
}
NEEDS = {"c": ["u", "i", "m"], "p": ["c"]}


def sql(body: str, *names: str) -> str:
    """``body`` after the canonical tables it names and their own."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTE[n] for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ", ".join([*parts, ""]) + body if parts else "WITH " + body
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
