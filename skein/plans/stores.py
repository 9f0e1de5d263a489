"""Queries of scans, ingest, the score cache and plain predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import labels as L
from skein.functions.ids import clean_id, valid_id
from skein.functions.predicates import fresh, has_all, has_any, matches
from skein.operators import cache, collections, ingest
from skein.operators.interactions import clean_terms
from skein.plans.canonical import AS_OF, items, merged, sql, users
from skein.plans.tables import table
from skein.sources import scans

S, D = SparkSession, str
QUERIES: dict = {}
SQL: dict[str, str] = {}
T0 = f"TIMESTAMP '{AS_OF}'"
PLAIN = ["item_id", "is_hidden", "timestamp", "brand", "type", "price", "comment"]
M = ["feedback_type", "user_id", "item_id", "value", "timestamp", "updated"]


def query(body: str | None = None, *needs: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *needs)
        return f

    return keep


@query("SELECT user_id, comment FROM u", "u")
def sc1_users(s: S, d: D) -> DataFrame:
    return users(s, d).select("user_id", "comment")


@query("SELECT item_id, is_hidden, timestamp, brand, type, price, comment FROM i WHERE timestamp >= TIMESTAMP '2013-10-01 00:00:00'", "i")
def sc2_items_since(s: S, d: D) -> DataFrame:
    return scans.items_since(items(s, d), "2013-10-01 00:00:00").select(*PLAIN)


@query("""SELECT feedback_type, user_id, item_id, value, timestamp FROM feedback WHERE (feedback_type = 'star' AND value >= 3 OR feedback_type = 'like')
  AND timestamp BETWEEN TIMESTAMP '2014-01-15 00:00:00' AND TIMESTAMP '2014-01-31 00:00:00' AND user_id >= 'usr-00001500' AND item_id <= 'itm-00001800'""")
def sc3_feedback_between(s: S, d: D) -> DataFrame:
    rows = scans.feedback_between(table(s, d, "feedback"), ["star>=3", "like"], "2014-01-15 00:00:00", "2014-01-31 00:00:00", ("usr-00001500", None), (None, "itm-00001800"))
    return rows.select("feedback_type", "user_id", "item_id", "value", "timestamp")


@query("SELECT user_id, comment FROM u WHERE user_id >= (SELECT user_id FROM u ORDER BY user_id LIMIT 1 OFFSET 20) ORDER BY user_id LIMIT 20", "u")
def sc4_users_second_page(s: S, d: D) -> DataFrame:
    rows = users(s, d).select("user_id", "comment")
    return scans.page(rows, "user_id", scans.page(rows, "user_id", "", 20)[1], 20)[0]


@query("SELECT item_id, timestamp FROM i WHERE timestamp >= TIMESTAMP '2013-10-01 00:00:00' ORDER BY item_id LIMIT 25", "i")
def sc5_items_page(s: S, d: D) -> DataFrame:
    return scans.page(scans.items_since(items(s, d), "2013-10-01 00:00:00").select("item_id", "timestamp"), "item_id", "", 25)[0]


@query(f"SELECT {', '.join(M)} FROM m ORDER BY feedback_type, user_id, item_id LIMIT 30 OFFSET 30", "m")
def sc6_feedback_second_page(s: S, d: D) -> DataFrame:
    rows = merged(s, d).select(*M)
    return scans.feedback_page(rows, scans.feedback_page(rows, "", 30)[1], 30)[0]


@query("SELECT item_id, is_hidden, timestamp, brand, type, price, comment FROM i WHERE item_id = (SELECT min(item_id) FROM i)", "i")
def sc7_item(s: S, d: D) -> DataFrame:
    rows = items(s, d)
    return scans.one(rows, "item_id", rows.agg(F.min("item_id")).first()[0]).select(*PLAIN)


@query("""SELECT item_id, timestamp FROM i WHERE item_id IN (SELECT trim(entity_id) FROM removals WHERE entity = 'item')
  AND NOT is_hidden AND timestamp > TIMESTAMP '2012-06-01 00:00:00'""", "i")
def sc8_items_among(s: S, d: D) -> DataFrame:
    ids = table(s, d, "removals").where("entity = 'item'").select(clean_id("entity_id").alias("item_id"))
    return scans.items_among(items(s, d), ids, None, True, "2012-06-01 00:00:00").select("item_id", "timestamp")


@query("SELECT item_id, timestamp FROM i WHERE NOT is_hidden AND list_contains(categories, 'home') AND timestamp > TIMESTAMP '2013-01-01 00:00:00' ORDER BY timestamp DESC, item_id LIMIT 40", "i")
def sc9_latest_items(s: S, d: D) -> DataFrame:
    return scans.latest_items(items(s, d), 40, ["home"], "2013-01-01 00:00:00").select("item_id", "timestamp")


_BUSY = "(SELECT user_id FROM m GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"
_HOT = "(SELECT item_id FROM m GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 1)"


def _most(rows: DataFrame, key: str) -> str:
    return rows.groupBy(key).count().orderBy(F.desc("count"), key).first()[0]


@query(f"SELECT {', '.join(M)} FROM m WHERE user_id = {_BUSY} AND timestamp <= {T0} AND (feedback_type = 'view' AND value >= 60 OR feedback_type = 'like')", "m")
def sc10_user_feedback(s: S, d: D) -> DataFrame:
    rows = merged(s, d)
    return scans.user_feedback(rows, _most(rows, "user_id"), AS_OF, ["view>=60", "like"]).select(*M)


@query(f"SELECT {', '.join(M)} FROM m WHERE item_id = {_HOT} AND timestamp <= {T0} AND feedback_type IN ('like', 'star')", "m")
def sc11_item_feedback(s: S, d: D) -> DataFrame:
    rows = merged(s, d)
    return scans.item_feedback(rows, _most(rows, "item_id"), AS_OF, ["like", "star"]).select(*M)


@query(f"SELECT {', '.join(M)} FROM m WHERE user_id = {_BUSY} AND item_id = {_HOT}", "m")
def sc12_user_item_feedback(s: S, d: D) -> DataFrame:
    rows = merged(s, d)
    return scans.user_item_feedback(rows, _most(rows, "user_id"), _most(rows, "item_id")).select(*M)


@query("SELECT 'users' AS name, count(*) AS n FROM users UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'feedback', count(*) FROM feedback")
def sc13_counts(s: S, d: D) -> DataFrame:
    return scans.counts(**{t: table(s, d, t) for t in ("users", "items", "feedback")})


@query("""SELECT item_id, is_hidden, timestamp FROM (SELECT * FROM (SELECT trim(entity_id) AS item_id, true AS is_hidden, removed_at AS timestamp,
    row_number() OVER (PARTITION BY trim(entity_id) ORDER BY removed_at) AS rn FROM removals WHERE entity = 'item' AND trim(entity_id) <> '') WHERE rn = 1)
  UNION ALL SELECT item_id, is_hidden, timestamp FROM i WHERE item_id NOT IN (SELECT trim(entity_id) FROM removals WHERE entity = 'item' AND entity_id IS NOT NULL)""", "i")
def sk1_upsert_items(s: S, d: D) -> DataFrame:
    batch = table(s, d, "removals").where("entity = 'item'").select(clean_id("entity_id").alias("item_id"), F.lit(True).alias("is_hidden"), F.col("removed_at").alias("timestamp")).where("item_id is not null")
    return ingest.upsert(items(s, d).select("item_id", "is_hidden", "timestamp"), batch, ["item_id"], [F.asc("timestamp")])


_HALF = "TIMESTAMP '2014-01-27 00:00:00'"


def _halves(s: S, d: D) -> tuple[DataFrame, DataFrame]:
    """Merged feedback from before a time, and the earliest raw row of each key after it."""
    raw = table(s, d, "feedback").where("timestamp is not null")
    half = F.lit("2014-01-27 00:00:00").cast("timestamp_ntz")
    new = ingest.merge_feedback(raw.where(F.col("timestamp") >= half))
    return ingest.merge_feedback(raw.where(F.col("timestamp") < half)), new


def _half_sql(test: str) -> str:
    return f"""SELECT lower(trim(feedback_type)) AS feedback_type, trim(user_id) AS user_id, trim(item_id) AS item_id,
        coalesce(round(sum(CASE WHEN isnan(value) THEN NULL ELSE value END), 6), 0) AS value, min(timestamp) AS timestamp, max(updated) AS updated
        FROM feedback WHERE trim(feedback_type) <> '' AND trim(user_id) <> '' AND trim(item_id) <> '' AND timestamp {test} {_HALF} GROUP BY 1, 2, 3"""


@query(f"""WITH o AS ({_half_sql('<')}), n AS ({_half_sql('>=')})
SELECT feedback_type, user_id, item_id, round(sum(value), 6) AS value, min(timestamp) AS timestamp, max(updated) AS updated FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2, 3""")
def sk3_accumulate(s: S, d: D) -> DataFrame:
    old, new = _halves(s, d)
    return ingest.insert_feedback(old, new, users(s, d), items(s, d), [F.asc("timestamp")])[0].select(*M)


@query(f"""WITH o AS ({_half_sql('<')}), n AS ({_half_sql('>=')}), k AS (SELECT * FROM n WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i))
SELECT * FROM k UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.feedback_type = o.feedback_type AND k.user_id = o.user_id AND k.item_id = o.item_id)""", "u", "i")
def sk3_overwrite_known(s: S, d: D) -> DataFrame:
    old, new = _halves(s, d)
    return ingest.insert_feedback(old, new, users(s, d), items(s, d), [F.asc("timestamp")], False, False, True)[0].select(*M)


@query("SELECT user_id FROM u UNION SELECT user_id FROM m", "u", "m")
def sk3_inserted_users(s: S, d: D) -> DataFrame:
    rows = merged(s, d)
    return ingest.insert_feedback(rows.limit(0), rows, users(s, d), items(s, d), [F.asc("timestamp")])[1].select("user_id")


@query("SELECT u.user_id, coalesce(p.comment, u.comment) AS comment FROM u LEFT JOIN (SELECT trim(entity_id) AS user_id, 'removed' AS comment FROM removals WHERE entity = 'user' GROUP BY 1) p ON p.user_id = u.user_id", "u")
def sk4_patch_users(s: S, d: D) -> DataFrame:
    patches = table(s, d, "removals").where("entity = 'user'").select(clean_id("entity_id").alias("user_id"), F.lit("removed").alias("comment")).distinct()
    return ingest.patch(users(s, d).select("user_id", "comment"), patches, "user_id")


@query(f"SELECT {', '.join(M)} FROM m WHERE item_id NOT IN (SELECT trim(entity_id) FROM removals WHERE entity = 'item' AND entity_id IS NOT NULL)", "m")
def sk5_delete_items(s: S, d: D) -> DataFrame:
    gone = table(s, d, "removals").where("entity = 'item'").select(clean_id("entity_id").alias("item_id"))
    return ingest.delete_owner(items(s, d), merged(s, d), gone, "item_id")[1].select(*M)


@query(f"SELECT {', '.join(M)} FROM m WHERE NOT (user_id = {_BUSY} AND item_id = {_HOT} AND feedback_type = 'view')", "m")
def sk6_delete_pair(s: S, d: D) -> DataFrame:
    rows = merged(s, d)
    return ingest.delete_pair(rows, _most(rows, "user_id"), _most(rows, "item_id"), ["view"])[0].select(*M)


@query("SELECT item_id, CASE WHEN item_id = (SELECT min(item_id) FROM i) AND NOT list_contains(categories, 'picked') THEN list_append(categories, 'picked') ELSE categories END AS categories FROM i", "i")
def sk11_add_category(s: S, d: D) -> DataFrame:
    rows = items(s, d).select("item_id", "categories")
    return ingest.add_category(rows, rows.agg(F.min("item_id")).first()[0], "picked")


_LAST = """last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, subset, id ORDER BY timestamp DESC NULLS LAST, score DESC NULLS LAST, coalesce(is_hidden, false) DESC, coalesce(array_to_string(categories, ','), '') DESC) AS rn FROM scores) WHERE rn = 1)"""
_CK = "collection, subset, id, score, is_hidden, timestamp"


def _last(s: S, d: D) -> DataFrame:
    return cache.latest_scores(table(s, d, "scores"))


@query(f"WITH {_LAST} SELECT {_CK} FROM last")
def ca1_latest_scores(s: S, d: D) -> DataFrame:
    return _last(s, d).select(*_CK.split(", "))


@query(f"""WITH {_LAST}, o AS (SELECT * FROM last WHERE collection <> 'latest'), n AS (SELECT 'recommend' AS collection, subset, id, score + 1 AS score, true AS is_hidden, timestamp FROM last WHERE collection = 'collaborative-filtering')
SELECT {_CK} FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.collection = o.collection AND n.subset = o.subset AND n.id = o.id)
UNION ALL SELECT n.collection, n.subset, n.id, n.score, CASE WHEN o.id IS NULL THEN n.is_hidden ELSE o.is_hidden END, n.timestamp FROM n LEFT JOIN o USING (collection, subset, id)""")
def ca1_add_scores(s: S, d: D) -> DataFrame:
    rows = _last(s, d).select(*_CK.split(", "))
    new = rows.where("collection = 'collaborative-filtering'").withColumns({"collection": F.lit("recommend"), "score": F.col("score") + 1, "is_hidden": F.lit(True)})
    return cache.add_scores(rows.where("collection <> 'latest'"), new)


@query(f"""WITH {_LAST} SELECT id, score FROM last WHERE collection = 'non-personalized' AND subset = 'trending' AND NOT coalesce(is_hidden, false) AND list_contains(categories, 'home') AND NOT isnan(score)
  AND score IS NOT NULL ORDER BY score DESC, id LIMIT 20 OFFSET 5""")
def ca2_search_scores(s: S, d: D) -> DataFrame:
    rows = _last(s, d).where("score is not null and not isnan(score)")
    return cache.search_scores(rows, "non-personalized", "trending", ["home"], 5, 25).select("id", "score")


@query(f"WITH {_LAST} SELECT collection, subset, id, score, CASE WHEN collection IN ('latest', 'non-personalized') AND id = (SELECT min(id) FROM last WHERE collection = 'latest') THEN true ELSE is_hidden END AS is_hidden FROM last")
def ca3_update_scores(s: S, d: D) -> DataFrame:
    rows = _last(s, d)
    first = rows.where("collection = 'latest'").agg(F.min("id")).first()[0]
    return cache.update_scores(rows, ["latest", "non-personalized"], first, is_hidden=True).select("collection", "subset", "id", "score", "is_hidden")


@query(f"WITH {_LAST} SELECT collection, subset, id FROM last WHERE NOT coalesce(collection IN ('recommend', 'latest') AND timestamp < TIMESTAMP '2014-01-20 00:00:00', false)")
def ca4_delete_scores(s: S, d: D) -> DataFrame:
    return cache.delete_scores(_last(s, d), ["recommend", "latest"], before="2014-01-20 00:00:00").select("collection", "subset", "id")


@query("SELECT entity AS name, trim(entity_id) AS value, max(removed_at) AS timestamp FROM removals GROUP BY 1, 2")
def ca7_queue(s: S, d: D) -> DataFrame:
    rows = table(s, d, "removals").select(F.col("entity").alias("name"), F.trim("entity_id").alias("value"), F.col("removed_at").alias("timestamp"))
    return cache.push(rows.limit(0), rows)


def _points(s: S, d: D) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("name"), F.col("ts").alias("timestamp"), "value")


@query("""SELECT name, timestamp, value FROM (SELECT event_type AS name, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS timestamp, value,
    row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY ts DESC, value DESC) AS rn FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00') WHERE rn = 1""")
def ca9_bucket_points(s: S, d: D) -> DataFrame:
    """Also WN1 and QP5."""
    return cache.bucket_points(_points(s, d), None, "2024-01-03 00:00:00", "2024-01-25 00:00:00", 86400)


@query("SELECT collection || CASE WHEN subset <> '' THEN '/' || subset ELSE '' END AS key, count(*) AS n FROM scores GROUP BY 1")
def ca10_keys(s: S, d: D) -> DataFrame:
    return table(s, d, "scores").groupBy(cache.key(F.col("collection"), F.col("subset")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LAST} SELECT collection, subset, id FROM last WHERE
  (collection IN ('recommend', 'collaborative-filtering') AND subset IN (SELECT user_id FROM u))
  OR (collection = 'item-to-item' AND split_part(subset, '/', 1) = 'neighbors' AND split_part(subset, '/', 2) IN (SELECT item_id FROM i))
  OR (collection = 'non-personalized' AND subset = 'trending')""", "u", "i")
def ca13_garbage(s: S, d: D) -> DataFrame:
    configured = s.createDataFrame([("recommend", None), ("collaborative-filtering", None), ("item-to-item", "neighbors"), ("non-personalized", "trending")], "collection string, name string")
    return cache.collect_garbage(_last(s, d), configured, users(s, d), items(s, d)).select("collection", "subset", "id")


@query(f"""WITH {_LAST}, l AS (SELECT subset, count(*) AS n, max(timestamp) AS made FROM last WHERE collection = 'recommend' GROUP BY 1), a AS (SELECT user_id, max(timestamp) AS active FROM m GROUP BY 1)
SELECT u.user_id, CASE WHEN coalesce(l.n, 0) = 0 THEN true WHEN l.made IS NULL THEN true WHEN a.active > l.made THEN true
  WHEN a.active IS NOT NULL AND datediff('microsecond', a.active, {T0}) // 1000000 > 864000 THEN false ELSE datediff('microsecond', l.made, {T0}) // 1000000 > 604800 END AS stale
FROM u LEFT JOIN l ON l.subset = u.user_id LEFT JOIN a ON a.user_id = u.user_id""", "u", "m")
def ca15_stale_users(s: S, d: D) -> DataFrame:
    lists = _last(s, d).where("collection = 'recommend'").groupBy(F.col("subset").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("made"))
    active = merged(s, d).groupBy("user_id").agg(F.max("timestamp").alias("active"))
    rows = users(s, d).select("user_id").join(lists, "user_id", "left").join(active, "user_id", "left")
    stale = cache.stale_recommendation(F.col("n"), F.lit("x"), "x", F.col("made"), F.col("active"), AS_OF, 604_800, 864_000)
    return rows.select("user_id", stale.alias("stale"))


@query("SELECT feedback_type, count(*) AS n FROM m WHERE feedback_type = 'star' AND value >= 3 OR feedback_type = 'view' AND value < 10 OR feedback_type = 'like' GROUP BY 1", "m")
def pr3_matches(s: S, d: D) -> DataFrame:
    """Also PR1, PR2 and PR4."""
    return merged(s, d).where(matches(["star>=3", "view<10", "like"])).groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id FROM i WHERE list_contains(tags, 'new') AND list_contains(tags, 'sale')", "i")
def pr5_all_of(s: S, d: D) -> DataFrame:
    return items(s, d).where(has_all(F.col("tags"), ["new", "sale"])).select("item_id")


@query("SELECT item_id FROM i WHERE list_has_any(tags, ['eco', 'gift'])", "i")
def ve3_any_of(s: S, d: D) -> DataFrame:
    return items(s, d).where(has_any(F.col("tags"), ["eco", "gift"])).select("item_id")


@query(f"SELECT item_id FROM i WHERE timestamp > {T0} - INTERVAL 120 DAY", "i")
def pr7_fresh(s: S, d: D) -> DataFrame:
    return items(s, d).where(fresh(F.col("timestamp"), AS_OF, 120, strict=True)).select("item_id")


@query("SELECT trim(item_id) AS id, 'brand:' || labels.brand AS label FROM items WHERE labels.brand IS NOT NULL UNION ALL SELECT trim(item_id), 'type:' || labels.\"type\" FROM items WHERE labels.\"type\" IS NOT NULL UNION ALL SELECT id, 'tags:' || t FROM (SELECT trim(item_id) AS id, unnest(labels.tags) AS t FROM items) WHERE t IS NOT NULL")
def pr12_labels(s: S, d: D) -> DataFrame:
    return L.flatten(table(s, d, "items").withColumn("item_id", F.trim("item_id")), "item_id", "labels")


@query("SELECT trim(user_id) AS id, 'segment.' || labels.segment AS name, 1.0::DOUBLE AS weight FROM users WHERE labels.segment IS NOT NULL UNION ALL SELECT trim(user_id), 'city.' || labels.city, 1.0 FROM users WHERE labels.city IS NOT NULL UNION ALL SELECT trim(user_id), 'balance.', labels.balance FROM users WHERE labels.balance IS NOT NULL")
def pr13_weighted_labels(s: S, d: D) -> DataFrame:
    return L.weighted(table(s, d, "users").withColumn("user_id", F.trim("user_id")), "user_id", "labels")


@query("WITH x AS (SELECT item_id AS id, unnest(tags) AS label FROM i) SELECT id, label FROM x WHERE label IN (SELECT label FROM x GROUP BY label HAVING count(*) >= 2)", "i")
def pr15_pruned_labels(s: S, d: D) -> DataFrame:
    return L.pruned(items(s, d).select(F.col("item_id").alias("id"), F.explode("tags").alias("label"))).select("id", "label")


@query("SELECT trim(item_id) AS item_id FROM item_embeddings WHERE len(vector) = (SELECT len(vector) FROM item_embeddings WHERE vector IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def pr16_modal_vectors(s: S, d: D) -> DataFrame:
    rows = table(s, d, "item_embeddings")
    return rows.where(F.size("vector") == L.modal_length(rows, "vector")).select(F.trim("item_id").alias("item_id"))


@query("SELECT feedback_type, count(*) AS n, CAST(count(*) FILTER (WHERE trim(user_id) <> '' AND NOT contains(user_id, '/') AND trim(item_id) <> '' AND NOT contains(item_id, '/')) AS BIGINT) AS valid FROM feedback GROUP BY 1")
def pr17_valid_ids(s: S, d: D) -> DataFrame:
    return table(s, d, "feedback").groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid_id(F.col("user_id")) & valid_id(F.col("item_id"))).alias("valid"))


_VECTORS = """v AS (SELECT trim(item_id) AS id, min(vector) AS vector FROM item_embeddings WHERE len(vector) = 64 AND trim(item_id) <> '' AND len(list_filter(vector, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"""


@query(f"WITH {_VECTORS}, q AS (SELECT vector AS q FROM v ORDER BY id LIMIT 1) SELECT id, round(list_distance(vector::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM v, q ORDER BY 2, id LIMIT 30")
def ve3_query_vectors(s: S, d: D) -> DataFrame:
    """Also DI1."""
    rows = vectors(s, d)
    q = rows.orderBy("id").first()["vector"]
    rows = rows.withColumns({"is_hidden": F.lit(False), "categories": F.lit(None).cast("array<string>")})
    return collections.query_vectors(rows, [float(x) for x in q], 30, "euclidean")


def vectors(s: S, d: D) -> DataFrame:
    rows = table(s, d, "item_embeddings").select(clean_id("item_id").alias("id"), "vector").where("id is not null and size(vector) = 64")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("vector").alias("vector"))


@query("SELECT trim(item_id) AS item_id, len(list_sort(list_distinct(list_filter(list_transform(coalesce(categories, []), lambda x: trim(lower(x))), lambda x: x IS NOT NULL AND x <> '')))) AS n FROM items WHERE item_id IS NOT NULL")
def pr12_clean_categories(s: S, d: D) -> DataFrame:
    return table(s, d, "items").where("item_id is not null").select(F.trim("item_id").alias("item_id"), F.size(clean_terms(F.col("categories"))).cast("bigint").alias("n"))
