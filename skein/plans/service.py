"""Queries of files, values, refreshes, ranking clients, streams and model tables, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import labels as L
from skein.functions.expressions import Compiler, checked
from skein.functions.ids import clean_id
from skein.functions.predicates import known_by
from skein.lineage import Scratch
from skein.models import factorization
from skein.operators import cache, collections, features, ingest, leaderboard, rank, recommend, similarity
from skein.operators import interactions as I  # noqa: E741
from skein.plans.canonical import AS_OF, classified, item_tags, items, liked, merged, sql, users
from skein.plans.recommender import _AUTO, _FAC, _LISTED, _PAIR, _RANK, factors
from skein.plans.stores import _LAST, _VECTORS, M, _last, _points, vectors
from skein.plans.tables import table
from skein.sources import files
from skein.streaming import feedback as streams

S, D = SparkSession, str
QUERIES: dict = {}
SQL: dict[str, str] = {}
T0 = f"TIMESTAMP '{AS_OF}'"


def query(body: str | None = None, *needs: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *needs)
        return f

    return keep


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


# files


@query("SELECT user_id, item_id FROM p", "p")
def sc14_train_lines(s: S, d: D) -> DataFrame:
    path = Scratch(s, "lines").root
    files.write_train(liked(s, d), path)
    return files.read_train(s, path)


@query("SELECT user_id, item_id, true AS positive FROM (SELECT user_id, min(item_id) AS item_id FROM p GROUP BY 1) UNION ALL SELECT user_id, item_id, false FROM c WHERE kind = 'negative' AND user_id IN (SELECT user_id FROM p)", "p")
def sc14_test_lines(s: S, d: D) -> DataFrame:
    """A positive of each user, and the negatives in its line."""
    path = Scratch(s, "lines").root
    kinds = classified(s, d)
    rows = liked(s, d).groupBy("user_id").agg(F.min("item_id").alias("item_id"))
    negatives = kinds.where("kind = 'negative'").groupBy("user_id").agg(F.collect_list("item_id").alias("negatives"))
    files.write_test(rows.join(negatives, "user_id", "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>"))), path)
    positives, others = files.read_test(s, path)
    return positives.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))


_KINDS = "SELECT user_id, count(*) FILTER (WHERE kind = 'positive') AS a, count(*) FILTER (WHERE kind = 'read') AS b, count(*) FILTER (WHERE kind = 'negative') AS n FROM c GROUP BY 1"


@query(f"WITH k AS ({_KINDS}), r AS (SELECT a, 0 AS i, b AS v FROM k UNION ALL SELECT a, 1, n FROM k) SELECT CAST(a AS DOUBLE) AS target, i AS index, CAST(v AS DOUBLE) AS value, count(*) AS n FROM r GROUP BY 1, 2, 3", "c")
def sc15_indexed_lines(s: S, d: D) -> DataFrame:
    path = Scratch(s, "lines").root
    one = lambda k: F.count_if(F.col("kind") == k)
    rows = classified(s, d).groupBy("user_id").agg(one("positive").alias("target"), F.array(one("read"), one("negative")).alias("values"))
    files.write_indexed(rows.withColumn("indices", F.array(F.lit(0), F.lit(1))), path)
    back = files.read_indexed(s, path).select("target", F.explode(F.arrays_zip("indices", "values")).alias("x"))
    return back.groupBy("target", F.col("x.indices").alias("index"), F.col("x.values").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sc19_csv(s: S, d: D) -> DataFrame:
    path = Scratch(s, "csv").root
    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"')
    return files.read_csv(s, path, rows.schema)


@query(f"SELECT {', '.join(M)} FROM m WHERE timestamp <= {T0} AND NOT contains(user_id, '/') AND NOT contains(item_id, '/')", "m")
def sk9_exported_feedback(s: S, d: D) -> DataFrame:
    """Also SC17: JSON lines written and imported again."""
    path = Scratch(s, "lines").root
    files.export_lines(merged(s, d), path, AS_OF)
    return _ntz(files.import_lines(s, "feedback", path)[0]).select(*M)


@query("SELECT item_id, is_hidden, categories, timestamp, comment FROM i WHERE NOT contains(item_id, '/')", "i")
def sc17_imported_items(s: S, d: D) -> DataFrame:
    path = Scratch(s, "lines").root
    files.export_lines(items(s, d).select("item_id", "is_hidden", "categories", "timestamp", "comment"), path)
    return _ntz(files.import_lines(s, "items", path)[0]).select("item_id", "is_hidden", "categories", "timestamp", "comment")


@query(f"SELECT {', '.join(M)} FROM m", "m")
def sk10_bundle(s: S, d: D) -> DataFrame:
    """Also SC18: a bundle dumped and restored."""
    path = Scratch(s, "bundle").root
    files.dump(path, feedback=merged(s, d), users=users(s, d))
    return files.restore(s, path, "feedback", "users")["feedback"].select(*M)


@query("SELECT user_id, comment FROM u", "u")
def sk8_compacted(s: S, d: D) -> DataFrame:
    path = Scratch(s, "compact").root
    files.compact(users(s, d).select("user_id", "comment"), path)
    return s.read.parquet(path)


@query("SELECT DISTINCT trim(entity_id) AS user_id, 'removed' AS comment FROM removals WHERE entity = 'user' AND trim(entity_id) <> '' UNION ALL SELECT user_id, comment FROM u WHERE user_id NOT IN (SELECT trim(entity_id) FROM removals WHERE entity = 'user' AND entity_id IS NOT NULL)", "u")
def sk2_upsert_users(s: S, d: D) -> DataFrame:
    batch = table(s, d, "removals").where("entity = 'user'").select(clean_id("entity_id").alias("user_id"), F.lit("removed").alias("comment"), "removed_at").where("user_id is not null")
    return ingest.upsert(users(s, d).select("user_id", "comment"), batch, ["user_id"], [F.asc("removed_at")])


@query("SELECT 'users' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'items', 0 UNION ALL SELECT 'feedback', 0")
def sk7_purged(s: S, d: D) -> DataFrame:
    from skein.sources.scans import counts

    return counts(**{t: ingest.purge(table(s, d, t)) for t in ("users", "items", "feedback")})


@query("SELECT item_id, CASE WHEN item_id = (SELECT min(item_id) FROM i WHERE list_contains(categories, 'home')) THEN list_filter(categories, lambda x: x <> 'home') ELSE categories END AS categories FROM i", "i")
def sk11_remove_category(s: S, d: D) -> DataFrame:
    rows = items(s, d).select("item_id", "categories")
    return ingest.remove_category(rows, rows.where(F.array_contains("categories", "home")).agg(F.min("item_id")).first()[0], "home")


# the cache


@query(f"WITH {_LAST} SELECT collection, subset, id, timestamp FROM last")
def ca5_scan_scores(s: S, d: D) -> DataFrame:
    return cache.scan_scores(_last(s, d))


@query("""WITH r AS (SELECT entity || '/' || trim(entity_id) AS name, removed_at FROM removals), o AS (SELECT name, 'old' AS value FROM r WHERE removed_at < TIMESTAMP '2014-01-27 00:00:00' GROUP BY 1),
n AS (SELECT name, CAST(min(removed_at) AS DATE) AS day FROM r WHERE removed_at >= TIMESTAMP '2014-01-15 00:00:00' GROUP BY 1), a AS (SELECT name, CAST(day AS VARCHAR) AS value FROM n UNION ALL SELECT name, value FROM o WHERE name NOT IN (SELECT name FROM n))
SELECT name, value FROM a WHERE name <> (SELECT min(name) FROM a)""")
def ca6_values(s: S, d: D) -> DataFrame:
    """Values set in two batches that overlap; of a name's rows in the second the earliest counts; then the least name goes."""
    rows = table(s, d, "removals").where("entity_id is not null").select(F.concat("entity", F.lit("/"), F.trim("entity_id")).alias("name"), "removed_at")
    old = rows.where("removed_at < timestamp_ntz'2014-01-27 00:00:00'").select("name", F.lit("old").alias("value"), "removed_at")
    new = rows.where("removed_at >= timestamp_ntz'2014-01-15 00:00:00'").select("name", F.to_date("removed_at").cast("string").alias("value"), "removed_at")
    meta = cache.set_values(old.limit(0).select("name", "value"), old, [F.asc("removed_at")])
    meta = cache.set_values(meta, new, [F.asc("removed_at")])
    return cache.delete_value(meta, meta.agg(F.min("name")).first()[0])


@query("""WITH q AS (SELECT entity AS name, trim(entity_id) AS value, max(removed_at) AS timestamp FROM removals GROUP BY 1, 2), f AS (SELECT value FROM q WHERE name = 'item' ORDER BY timestamp, value LIMIT 1)
SELECT name, count(*) AS n, count(*) FILTER (WHERE value = (SELECT value FROM f) AND name = 'item') AS popped FROM q WHERE NOT (name = 'item' AND value = (SELECT value FROM f)) GROUP BY 1""")
def ca7_popped(s: S, d: D) -> DataFrame:
    """How many values remain in each queue once the oldest item was taken."""
    rows = table(s, d, "removals").select(F.col("entity").alias("name"), F.trim("entity_id").alias("value"), F.col("removed_at").alias("timestamp"))
    value, left = cache.pop(cache.push(rows.limit(0), rows), "item")
    return left.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("value") == value) & (F.col("name") == "item")).alias("popped"))


_DAY = "make_timestamp(epoch_us(ts) // 86400000000 * 86400000000)"


@query(f"""WITH e AS (SELECT event_type AS name, {_DAY} AS timestamp, max(value) AS value FROM events GROUP BY 1, 2), n AS (SELECT name, timestamp, value + 1 AS value FROM e WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00')
SELECT name, timestamp, value FROM n UNION ALL SELECT name, timestamp, value FROM e WHERE timestamp < TIMESTAMP '2024-01-10 00:00:00'""")
def ca8_points(s: S, d: D) -> DataFrame:
    rows = _points(s, d).groupBy("name", F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("timestamp")).agg(F.max("value").alias("value"))
    new = rows.where("timestamp >= timestamp_ntz'2024-01-10 00:00:00'").withColumn("value", F.col("value") + 1)
    return cache.add_points(rows, new)


@query("""WITH x AS (SELECT event_type AS name, ts, epoch_us(ts) // 86400000000 AS day, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-18 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00')
SELECT name, make_timestamp(day * 86400000000) AS timestamp, arg_max(value, (ts, value)) AS value FROM x GROUP BY name, day""")
def qp5_recent_points(s: S, d: D) -> DataFrame:
    return cache.recent_points(_points(s, d), None, "2024-01-25 00:00:00")


@query(f"""WITH {_LAST}, l AS (SELECT subset, count(*) AS n, max(timestamp) AS made FROM last WHERE collection = 'item-to-item' GROUP BY 1)
SELECT i.item_id, coalesce(l.n, 0) = 0 OR l.n % 3 = 0 OR l.made IS NULL OR datediff('microsecond', l.made, {T0}) // 1000000 > 1728000 AS stale FROM i LEFT JOIN l ON l.subset = 'neighbors/' || i.item_id""", "i")
def ca14_stale_lists(s: S, d: D) -> DataFrame:
    """Lists whose length is divisible by three stand for those of another configuration."""
    lists = _last(s, d).where("collection = 'item-to-item'").groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("made"))
    rows = items(s, d).select("item_id", F.concat(F.lit("neighbors/"), "item_id").alias("subset")).join(lists, "subset", "left")
    made_by = F.when(F.col("n") % 3 == 0, "other").otherwise("this")
    return rows.select("item_id", cache.stale_list(made_by, "this", F.col("made"), AS_OF, 1_728_000, F.col("n")).alias("stale"))


@query("SELECT item_id, md5(coalesce(array_to_string(categories, ''), '')) AS digest FROM i", "i")
def ca16_digests(s: S, d: D) -> DataFrame:
    return items(s, d).select("item_id", cache.digests(F.col("categories")).alias("digest"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS uuid, max((ts, event_type)) AS last FROM events GROUP BY 1) SELECT uuid, last[2] AS kind, last[1] AS updated FROM e WHERE last[1] > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 86400 SECOND""")
def sk16_running_nodes(s: S, d: D) -> DataFrame:
    """Users of the event stream as nodes: those heard of within a day."""
    rows = table(s, d, "events").select(F.col("user_id").cast("string").alias("uuid"), F.col("event_type").alias("kind"), F.lit("").alias("host"), F.col("ts").cast("timestamp_ntz").alias("updated"))
    return cache.running(cache.announce(rows.limit(0), rows), "2024-01-25 00:00:00", 86_400).select("uuid", "kind", "updated")


@query("SELECT DISTINCT c AS category, rtrim(to_base64(encode('_' || c)), '=') AS tag, true AS back FROM (SELECT unnest(categories) AS c FROM i)", "i")
def ca11_tags(s: S, d: D) -> DataFrame:
    """Categories as tags, and whether each comes back from its tag."""
    rows = items(s, d).select(F.explode("categories").alias("category")).distinct().withColumn("tag", cache.tag(F.col("category")))
    return rows.withColumn("back", cache.untag(F.col("tag")) == F.col("category"))


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1", "c")
def sk15_blobs(s: S, d: D) -> DataFrame:
    """A small table as a named file, written, replaced and read again."""
    import json

    from skein.sources.blobs import Blobs

    store = Blobs(s, Scratch(s, "blobs").root)
    counts = {r["kind"]: r["n"] for r in classified(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    store.write("models/counts.json", b"{}")
    store.write("models/counts.json", json.dumps(counts).encode())
    return s.createDataFrame(sorted(json.loads(store.read("models/counts.json")).items()), "kind string, n long")


# predicates, labels, joins


@query(f"""WITH a AS (SELECT *, feedback_type = 'skip' AS neg, feedback_type IN ('purchase', 'like', 'share') OR (feedback_type = 'star' AND value >= 3) AS pos, feedback_type IN ('view', 'click') AS rd
  FROM m WHERE timestamp <= {T0} AND timestamp >= {T0} - INTERVAL 14 DAY)
SELECT user_id, item_id, CASE WHEN bool_or(neg) THEN 'negative' WHEN bool_or(pos) THEN 'positive' ELSE 'read' END AS kind FROM a WHERE (neg OR pos OR rd) AND user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i) GROUP BY 1, 2""", "u", "i", "m")
def pr8_recent_feedback(s: S, d: D) -> DataFrame:
    """Feedback of the last fourteen days only."""
    return I.classify(merged(s, d), users(s, d), items(s, d), AS_OF, ttl_days=14).select("user_id", "item_id", "kind")


@query("""SELECT * FROM (VALUES ('len(feedback)', 'number', true), ('len(feedback) > 2', 'number', false), ('item.IsHidden', 'boolean', true), ('item.ItemId', 'boolean', false),
('(now() - item.Timestamp).Hours()', 'number', true), ('item.Comment', 'number', false)) AS v(expression, wanted, accepted)""")
def pr10_type_checks(s: S, d: D) -> DataFrame:
    """Which expressions may be a score or a filter, told from their types before anything runs."""
    rows = items(s, d).withColumn("fb_item_id", F.lit("x"))
    told = []
    for text, wanted in (("len(feedback)", "number"), ("len(feedback) > 2", "number"), ("item.IsHidden", "boolean"), ("item.ItemId", "boolean"), ("(now() - item.Timestamp).Hours()", "number"), ("item.Comment", "number")):
        try:
            checked(rows, Compiler(AS_OF).compile(text), wanted)
            told.append((text, wanted, True))
        except TypeError:
            told.append((text, wanted, False))
    return s.createDataFrame(told, "expression string, wanted string, accepted boolean")


@query("SELECT trim(item_id) AS item_id, labels.price AS price, coalesce(len(labels.tags), 0)::DOUBLE AS n_tags FROM items")
def pr11_label_paths(s: S, d: D) -> DataFrame:
    c = Compiler(AS_OF)
    return table(s, d, "items").select(F.trim("item_id").alias("item_id"), c.compile("item.Labels.price").alias("price"), c.compile("len(item.Labels.tags)").alias("n_tags"))


@query("SELECT trim(item_id) AS id, 'image.vector' AS name, len(vector) AS n, round(vector[1]::DOUBLE, 6) AS first FROM item_embeddings WHERE vector IS NOT NULL")
def pr14_label_vectors(s: S, d: D) -> DataFrame:
    rows = table(s, d, "item_embeddings").select(F.trim("item_id").alias("item_id"), F.struct(F.struct("vector").alias("image"), "categories").alias("labels"))
    found = L.embeddings(rows, "item_id", "labels")
    return found.select("id", "name", F.size("vector").cast("bigint").alias("n"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT trim(item_id) AS item_id, (labels.price IS NULL OR labels.brand IS NULL) AND coalesce(len(list_filter(labels.tags, lambda x: x IS NULL)), 0) = 0 AS valid FROM items")
def pr18_valid_labels(s: S, d: D) -> DataFrame:
    """Labels as JSON: a list of a price and a brand is no valid label, nor is a list with a null; anything else here is."""
    import json

    both = F.col("labels.price").isNotNull() & F.col("labels.brand").isNotNull()
    text = F.when(both, F.to_json(F.array(F.col("labels.price").cast("string"), "labels.brand"))).otherwise(F.to_json("labels"))

    @F.pandas_udf("boolean")
    def valid(mixed: pd.Series, text: pd.Series) -> pd.Series:
        def one(m, t):
            value = None if t is None else json.loads(t)
            return L.valid_labels([float(value[0]), value[1]] if m else value)

        return pd.Series([one(m, t) for m, t in zip(mixed, text)])

    return table(s, d, "items").select(F.trim("item_id").alias("item_id"), valid(both, text).alias("valid"))


@query(f"WITH {_LAST} SELECT l.subset, l.id AS item_id, l.score, i.brand, i.price FROM last l JOIN i ON i.item_id = l.id WHERE l.collection = 'recommend' AND l.score IS NOT NULL AND NOT isnan(l.score)", "i")
def pr19_enriched(s: S, d: D) -> DataFrame:
    scored = _last(s, d).where("collection = 'recommend' and score is not null and not isnan(score)").select("subset", F.col("id").alias("item_id"), "score")
    return rank.enriched(scored, items(s, d), "item_id").select("subset", "item_id", "score", "brand", "price")


@query("SELECT item_id, count(*) AS n, 1::BIGINT AS ranges FROM m GROUP BY 1", "m")
def jn10_item_ranges(s: S, d: D) -> DataFrame:
    """Each item's feedback lies in one of the ranges."""
    rows = I.by_item_ranges(merged(s, d), 8).withColumn("range", F.spark_partition_id())
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("range").alias("ranges"))


@query("WITH w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC, user_id) AS rn FROM p) SELECT item_id, list(user_id ORDER BY rn) AS users FROM w WHERE rn <= 5 GROUP BY 1", "p")
def jn11_item_histories(s: S, d: D) -> DataFrame:
    return I.item_histories(classified(s, d), 5)


_CONTEXT = f"""x AS (SELECT user_id, item_id, feedback_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id, feedback_type) AS INTEGER) AS place FROM m
  WHERE timestamp <= {T0} AND (feedback_type IN ('purchase', 'like', 'share') OR feedback_type = 'star' AND value >= 3))"""


@query(f"WITH {_CONTEXT} SELECT user_id, place, feedback_type, i.item_id, i.brand, i.comment FROM x JOIN i USING (item_id) WHERE place <= 5", "i", "m")
def jn12_prompt_contexts(s: S, d: D) -> DataFrame:
    return I.prompt_contexts(merged(s, d), items(s, d), AS_OF, 5).select("user_id", "place", "feedback_type", "item_id", "brand", "comment")


@query("""SELECT 'users' AS name, count(*) AS n FROM u UNION ALL SELECT 'items', count(*) FROM i UNION ALL SELECT kind, count(*) FROM c GROUP BY 1
UNION ALL SELECT 'item_labels', count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM i)
UNION ALL SELECT 'user_labels', count(DISTINCT l) FROM (SELECT 'segment:' || labels.segment AS l FROM users UNION ALL SELECT 'city:' || labels.city FROM users)""", "c")
def ag9_label_counts(s: S, d: D) -> DataFrame:
    tags = item_tags(s, d).select(F.col("token").alias("label"))
    return I.statistics(users(s, d), items(s, d), classified(s, d), item_labels=tags, user_labels=L.flatten(table(s, d, "users"), "user_id", "labels"))


@query("SELECT user_id, item_id FROM c WHERE kind <> 'positive'", "c")
def se2_not_positive(s: S, d: D) -> DataFrame:
    return I.not_positive(classified(s, d))


@query("""WITH b AS (SELECT item_id FROM i WHERE NOT is_hidden AND timestamp IS NOT NULL ORDER BY timestamp DESC, item_id LIMIT 15)
SELECT user_id, item_id FROM u, b WHERE NOT EXISTS (SELECT 1 FROM c WHERE kind IN ('positive', 'negative') AND c.user_id = u.user_id AND c.item_id = b.item_id)""", "c")
def se4_excluded(s: S, d: D) -> DataFrame:
    kinds = classified(s, d)
    rows = recommend.list_candidates(users(s, d), leaderboard.latest(items(s, d), 15), 15).select("user_id", "item_id")
    return I.exclude_all(rows, I.positives(kinds), kinds.where("kind = 'negative'"))


# neighbours of users


_USER_TAGS = "SELECT DISTINCT trim(user_id) AS id, l AS token FROM (SELECT user_id, 'segment:' || lower(trim(labels.segment)) AS l FROM users UNION ALL SELECT user_id, 'city:' || lower(trim(labels.city)) FROM users) WHERE trim(user_id) <> '' AND l IS NOT NULL"


def _user_tags(s: S, d: D) -> DataFrame:
    rows = table(s, d, "users").select(clean_id("user_id").alias("id"), F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.lower(F.trim(f"labels.{k}"))) for k in ("segment", "city")])).alias("token"))
    return rows.where("id is not null and token is not null").distinct()


@query(f"WITH t AS ({_USER_TAGS}), n AS (SELECT count(*) AS n FROM u), {_PAIR}, {_RANK.format(hide='')} SELECT id, neighbour, score, rank FROM k WHERE rank <= 10", "u")
def rc10_users_by_tags(s: S, d: D) -> DataFrame:
    tokens = _user_tags(s, d)
    return similarity.token_neighbours(tokens, features.idf(tokens, users(s, d).count()), 10)


@query(_AUTO.replace("SELECT item_id AS id, unnest(tags) AS token FROM i", _USER_TAGS).replace("SELECT item_id AS id, user_id AS token FROM p", "SELECT user_id AS id, item_id AS token FROM p").replace("SELECT count(*) AS n FROM i", "SELECT count(*) AS n FROM u").replace("AND b NOT IN (SELECT item_id FROM i WHERE is_hidden)", ""), "p")
def rc10_users_auto(s: S, d: D) -> DataFrame:
    total, kinds = users(s, d).count(), [_user_tags(s, d), liked(s, d).select(F.col("user_id").alias("id"), F.col("item_id").alias("token"))]
    return similarity.shared_token_neighbours([(t, features.idf(t, total)) for t in kinds], 10)


@query(f"""WITH {_FAC.format(n='v', side='user')}, h AS (SELECT a.id, b.id AS neighbour, round(list_distance(a.x, b.x), 6) AS distance FROM v a, v b WHERE a.id <> b.id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM h WHERE distance > 0) SELECT * FROM k WHERE rank <= 5""")
def rc10_users_by_vectors(s: S, d: D) -> DataFrame:
    return similarity.vector_neighbours(factors(s, d, "user"), 5)


# rankers, clients, refresh


@query("SELECT user_id, unnest(['x' || right(user_id, 2), 'y' || right(user_id, 1)]) AS item_id, 0.0::DOUBLE AS score, unnest([1, 2]) AS rank FROM u", "u")
def rc13_external(s: S, d: D) -> DataFrame:
    return rank.external(users(s, d), lambda user: ["x" + user[-2:], "y" + user[-1:], "x" + user[-2:]])


@query(f"""WITH {_LISTED}, f AS (SELECT item_id, count(*) AS n FROM p GROUP BY 1), g AS (SELECT b1.user_id, b1.item_id, CAST(f.n AS DOUBLE) AS score FROM b1 LEFT JOIN f ON f.item_id = b1.item_id AND f.n > 2)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, item_id) AS INTEGER) AS rank FROM g""", "p")
def rc18_ranked(s: S, d: D) -> DataFrame:
    """Candidates in the order of a score per pair, which few have."""
    lists = recommend.list_candidates(users(s, d), leaderboard.latest(items(s, d), 15), 15, classified(s, d))
    counts = liked(s, d).groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score")).where("score > 2")
    return rank.rank_by_score(lists, lists.select("user_id", "item_id").join(counts, "item_id"))


@query(f"""WITH {_CONTEXT}, y AS (SELECT user_id, place, i.item_id, coalesce(len(i.comment), 0) AS l FROM x JOIN i USING (item_id) WHERE place <= 5)
SELECT user_id, item_id, CAST(l AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY l DESC, place) AS INTEGER) AS rank FROM y""", "i", "m")
def rc19_ranked_by_client(s: S, d: D) -> DataFrame:
    """A client that puts longer documents first."""
    rows = I.prompt_contexts(merged(s, d), items(s, d), AS_OF, 5).select("user_id", F.struct("place", "item_id", F.coalesce("comment", F.lit("")).alias("comment")).alias("x"))
    prompts = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    prompts = prompts.select("user_id", F.lit("which first?").alias("query"), F.col("x.item_id").alias("item_ids"), F.col("x.comment").alias("documents"))
    return rank.rank_by_client(prompts, lambda query, documents: sorted(((k, float(len(t))) for k, t in enumerate(documents)), key=lambda x: (-x[1], x[0])))


@query("SELECT item_id, categories AS names FROM i", "i")
def rc20_parsed(s: S, d: D) -> DataFrame:
    """Categories as the answer of a client: a thought and a fenced list, one fenced block of another kind before it."""
    answer = F.concat(F.lit("<think>```json\n[1]\n```</think>So:\n```text\nno\n```\n```json\n"), F.to_json("categories"), F.lit("\n```\nDone."))

    @F.pandas_udf("array<string>")
    def parsed(text: pd.Series) -> pd.Series:
        return text.map(rank.parse_completion)

    return items(s, d).select("item_id", parsed(answer).alias("names"))


@query(f"""WITH {_LISTED}, w AS (SELECT 'read' AS feedback_type, user_id, item_id, 0.0 AS value, {T0} + INTERVAL 1 HOUR AS timestamp FROM b1 WHERE rank <= 2 UNION ALL SELECT feedback_type, user_id, item_id, value, timestamp FROM m)
SELECT feedback_type, count(*) AS n, CAST(count(*) FILTER (WHERE timestamp <= {T0}) AS BIGINT) AS known FROM w GROUP BY 1""", "p")
def rc23_written_back(s: S, d: D) -> DataFrame:
    """What was served counts as read an hour later, not before."""
    served = recommend.list_candidates(users(s, d), leaderboard.latest(items(s, d), 15), 15, classified(s, d)).where("rank <= 2")
    rows = recommend.write_back(merged(s, d).select(*M, "comment"), served, "read", AS_OF, 3600)
    return rows.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(known_by(F.col("timestamp"), AS_OF)).alias("known"))


@query(f"""WITH {_LISTED}, {_LAST}, l AS (SELECT subset, count(*) AS n, max(timestamp) AS made FROM last WHERE collection = 'recommend' GROUP BY 1), a AS (SELECT user_id, max(timestamp) AS active FROM m GROUP BY 1),
st AS (SELECT u.user_id FROM u LEFT JOIN l ON l.subset = u.user_id LEFT JOIN a ON a.user_id = u.user_id WHERE CASE WHEN coalesce(l.n, 0) = 0 THEN true WHEN l.made IS NULL THEN true WHEN a.active > l.made THEN true
  WHEN a.active IS NOT NULL AND datediff('microsecond', a.active, {T0}) // 1000000 > 864000 THEN false ELSE datediff('microsecond', l.made, {T0}) // 1000000 > 604800 END),
w AS (SELECT user_id FROM st WHERE user_id IN (SELECT user_id FROM m GROUP BY 1 HAVING max(timestamp) >= {T0} - INTERVAL 7 DAY)),
f AS (SELECT subset AS user_id, id AS item_id, score, CAST(row_number() OVER (PARTITION BY subset ORDER BY score DESC, id) AS INTEGER) AS rank FROM last WHERE collection = 'collaborative-filtering' AND NOT coalesce(is_hidden, false) AND score IS NOT NULL AND NOT isnan(score) AND subset IN (SELECT user_id FROM u)),
x AS (SELECT user_id, item_id, score, 0 AS source, rank AS r FROM f UNION ALL SELECT user_id, item_id, score, 1, rank FROM b1),
y AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY source, r) AS o FROM x WHERE user_id IN (SELECT user_id FROM w) AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = x.user_id AND c.item_id = x.item_id)),
z AS (SELECT user_id, item_id, score, source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY source, r, item_id) AS INTEGER) AS rank FROM y WHERE o = 1)
SELECT user_id, item_id, score, CAST(source AS INTEGER) AS source, rank FROM z WHERE rank <= 12""", "p")
def rc24_refreshed(s: S, d: D) -> DataFrame:
    """Lists of users that were active in the last week and whose list is stale: the collaborative one, then the latest items."""
    last, kinds, everyone = _last(s, d), classified(s, d), users(s, d)
    lists = last.where("collection = 'recommend'").groupBy(F.col("subset").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("made"))
    seen = merged(s, d).groupBy("user_id").agg(F.max("timestamp").alias("active"))
    state = everyone.select("user_id").join(lists, "user_id", "left").join(seen, "user_id", "left")
    stale = state.where(cache.stale_recommendation(F.col("n"), F.lit("x"), "x", F.col("made"), F.col("active"), AS_OF, 604_800, 864_000))
    found = recommend.search(last.where("score is not null and not isnan(score)"), "collaborative-filtering", everyone, kinds.limit(0), 0, 1 << 30)
    fallback = recommend.list_candidates(everyone, leaderboard.latest(items(s, d), 15), 15, kinds)
    return recommend.refresh(everyone, I.active_users(merged(s, d), AS_OF, 7), stale, [found], [fallback], 12, kinds)


# model tables


@query(f"""WITH {_FAC.format(n='fu', side='user')}, {_FAC.format(n='fi', side='item')}
SELECT c.user_id, c.item_id, coalesce(round(list_inner_product(fu.x, fi.x), 6), 0) AS score FROM c LEFT JOIN fu ON fu.id = c.user_id LEFT JOIN fi ON fi.id = c.item_id""", "c")
def md3_predictions(s: S, d: D) -> DataFrame:
    made = [factors(s, d, k).withColumn("kind", F.lit(k)) for k in ("user", "item")]
    return factorization.predict(classified(s, d).select("user_id", "item_id"), made[0].unionByName(made[1])).withColumn("score", F.round("score", 6))


@query("SELECT item_id, item_id IN (SELECT item_id FROM p) AS predictable FROM i", "p")
def md4_predictable(s: S, d: D) -> DataFrame:
    return factorization.predictable(items(s, d), liked(s, d), "item_id")


# vector collections


@query(f"""WITH {_VECTORS}, w AS (SELECT v.id, i.categories, i.timestamp, v.vector FROM v JOIN i ON i.item_id = v.id WHERE NOT i.is_hidden), q AS (SELECT vector AS q FROM v ORDER BY id LIMIT 1)
SELECT id, round(list_distance(vector::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM w, q WHERE (timestamp IS NULL OR timestamp >= TIMESTAMP '2012-06-01 00:00:00') AND list_has_any(categories, ['home', 'garden', 'kitchen']) ORDER BY 2, id LIMIT 25""", "i")
def ve3_any_of_top(s: S, d: D) -> DataFrame:
    """Also VE1 and VE2: a collection made, filled, emptied of what is older than a time, and searched in any of three categories."""
    rows = vectors(s, d)
    q = [float(x) for x in rows.orderBy("id").first()["vector"]]
    store = collections.VectorStore(s, Scratch(s, "vectors").root)
    store.add_collection("items", "euclidean")
    info = items(s, d).select(F.col("item_id").alias("id"), "is_hidden", "categories", F.col("timestamp").cast("timestamp").alias("timestamp"))
    store.add("items", rows.join(info, "id"))
    store.delete_before("items", "2012-06-01 00:00:00")
    return store.query("items", q, 25, ["home", "garden", "kitchen"])


@query("SELECT unnest(['items', 'users']) AS name")
def ve1_collections(s: S, d: D) -> DataFrame:
    """Three collections made and one of them taken away again; another object finds what is left."""
    root = Scratch(s, "vectors").root
    store = collections.VectorStore(s, root)
    for name in ("items", "users", "gone"):
        store.add_collection(name, "cosine")
    store.delete_collection("gone")
    return s.createDataFrame([(n,) for n in collections.VectorStore(s, root).collections()], "name string")


# streams


def _streamed(s: S, df: DataFrame, mode: str, columns: list[str]) -> DataFrame:
    """What a stream writes when it has read what is there."""
    scratch = Scratch(s, "stream")
    out = f"{scratch.root}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{scratch.root}/progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


@query("SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, feedback_type, count(*) AS n FROM feedback WHERE timestamp IS NOT NULL AND feedback_type IN ('like', 'view') GROUP BY 1, 2")
def st2_daily_counts(s: S, d: D) -> DataFrame:
    """Counts by day as a stream keeps them; of each day the last is the newest."""
    rows = _streamed(s, streams.daily_counts(streams.read_table(s, d, "feedback"), ["like", "view"]), "update", ["day", "feedback_type", "n"])
    return rows.groupBy(F.col("day").cast("string").alias("day"), "feedback_type").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT feedback_type, count(*) AS n FROM feedback WHERE timestamp IS NOT NULL GROUP BY 1")
def st3_visible_now(s: S, d: D) -> DataFrame:
    """Also ST4: all dated feedback is older than the clock."""
    rows = _streamed(s, streams.visible_now(streams.read_table(s, d, "feedback")), "append", ["feedback_type", "timestamp"])
    return rows.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trim(user_id) AS id, max(timestamp) AS last_modified FROM feedback WHERE trim(user_id) <> '' AND timestamp IS NOT NULL GROUP BY 1")
def st6_marks(s: S, d: D) -> DataFrame:
    """Also ST7 as a stream: an id's latest event."""
    rows = _streamed(s, streams.last_modified(streams.read_table(s, d, "feedback"), "user_id"), "update", ["id", "last_modified"])
    return rows.groupBy("id").agg(F.max("last_modified").cast("timestamp_ntz").alias("last_modified"))
