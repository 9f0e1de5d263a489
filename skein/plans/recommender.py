"""Queries of interactions, features, similarity, candidates, evaluation and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.expressions import Compiler
from skein.functions.ids import clean_id
from skein.functions.vectors import METRICS
from skein.operators import evaluate, features, leaderboard, recommend, similarity
from skein.operators import interactions as I  # noqa: E741
from skein.plans.canonical import AS_OF, classified, item_tags, items, liked, merged, sql, users
from skein.plans.stores import vectors
from skein.plans.tables import table

S, D = SparkSession, str
QUERIES: dict = {}
SQL: dict[str, str] = {}
T0 = f"TIMESTAMP '{AS_OF}'"
TEST_FROM = "2014-01-27 00:00:00"


def query(body: str | None = None, *needs: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *needs)
        return f

    return keep


@query("SELECT feedback_type, user_id, item_id, value, timestamp, updated FROM m", "m")
def ag1_merge_feedback(s: S, d: D) -> DataFrame:
    return merged(s, d).select("feedback_type", "user_id", "item_id", "value", "timestamp", "updated")


@query("SELECT user_id, item_id, kind, timestamp, n_positive FROM c", "c")
def jn3_classified(s: S, d: D) -> DataFrame:
    """JN1 to JN3."""
    return classified(s, d)


@query("SELECT user_id, item_id, CAST(CASE WHEN kind = 'positive' THEN 1 ELSE -1 END AS INTEGER) AS target, timestamp FROM c", "c")
def ag13_samples(s: S, d: D) -> DataFrame:
    return I.samples(classified(s, d))


@query(f"SELECT user_id, feedback_type, sum(value) AS total FROM (SELECT user_id, feedback_type, round(value, 2) AS value FROM m WHERE timestamp <= {T0}) GROUP BY 1, 2 HAVING count(*) >= 10 AND sum(value) >= 50", "m")
def ag2_busy_users(s: S, d: D) -> DataFrame:
    return I.busy_users(merged(s, d), AS_OF, 10, 50)


@query("SELECT item_id, CAST(sum(n_positive) AS BIGINT) AS freq FROM p GROUP BY 1", "p")
def ag3_item_frequency(s: S, d: D) -> DataFrame:
    return I.frequency(classified(s, d), "item_id")


def _idf_sql(tokens: str, total: str) -> str:
    return f"WITH t AS ({tokens}) SELECT token, count(*) AS freq, round(greatest(ln((SELECT count(*) FROM {total}) / count(*)), 0.001), 6) AS idf FROM t GROUP BY token"


def _idf(tokens: DataFrame, owners: DataFrame) -> DataFrame:
    return features.idf(tokens, owners.count()).withColumn("idf", F.round("idf", 6))


@query(_idf_sql("SELECT user_id AS token FROM p", "i"), "p")
def ag4_user_idf(s: S, d: D) -> DataFrame:
    return _idf(liked(s, d).select(F.col("user_id").alias("token")), items(s, d))


@query(_idf_sql("SELECT item_id AS token FROM p", "u"), "p")
def ag5_item_idf(s: S, d: D) -> DataFrame:
    return _idf(liked(s, d).select(F.col("item_id").alias("token")), users(s, d))


@query(_idf_sql("SELECT DISTINCT trim(user_id) || ':' || lower(trim(labels.segment)) AS x, lower(trim(labels.segment)) AS token FROM users WHERE trim(labels.segment) <> '' AND trim(user_id) <> ''", "u"), "u")
def ag6_user_label_idf(s: S, d: D) -> DataFrame:
    rows = table(s, d, "users").select(clean_id("user_id").alias("id"), F.lower(F.trim("labels.segment")).alias("token")).where("id is not null and token <> ''").distinct()
    return _idf(rows, users(s, d))


@query(_idf_sql("SELECT unnest(tags) AS token FROM i", "i"), "i")
def ag7_item_label_idf(s: S, d: D) -> DataFrame:
    return _idf(item_tags(s, d), items(s, d))


@query("SELECT category, count(*) AS n_items FROM (SELECT unnest(categories) AS category FROM i) GROUP BY 1", "i")
def ag8_category_counts(s: S, d: D) -> DataFrame:
    return I.category_counts(items(s, d))


@query("SELECT 'users' AS name, count(*) AS n FROM u UNION ALL SELECT 'items', count(*) FROM i UNION ALL SELECT kind, count(*) FROM c GROUP BY 1", "c")
def ag9_statistics(s: S, d: D) -> DataFrame:
    return I.statistics(users(s, d), items(s, d), classified(s, d))


@query("SELECT user_id IN (SELECT user_id FROM p) AS active, count(*) AS n FROM u GROUP BY 1", "p")
def ag10_active_users(s: S, d: D) -> DataFrame:
    return I.activity(users(s, d), classified(s, d), "user_id")


_SCORED = "s AS (SELECT i.item_id, any_value(i.categories) AS categories, CAST(count(p.item_id) AS DOUBLE) AS score FROM i LEFT JOIN p ON p.item_id = i.item_id WHERE NOT i.is_hidden GROUP BY 1)"
_TOPS = f"""{_SCORED}, e AS (SELECT item_id, score, '' AS category FROM s UNION ALL SELECT item_id, score, unnest(categories) FROM s),
t AS (SELECT category, item_id, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, item_id) AS rank FROM e)"""


def _scored(s: S, d: D, score: str = "len(feedback)", filter: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    return leaderboard.scored_items(items(s, d), liked(s, d) if rows is None else rows, AS_OF, score, filter)


@query(f"WITH {_TOPS} SELECT category, item_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10", "p")
def wn4_top_by_category(s: S, d: D) -> DataFrame:
    """Also AG11 and WN2."""
    return leaderboard.top_by_category(_scored(s, d), 10)


@query(f"WITH {_TOPS} SELECT item_id, max(score) AS score, list_sort(list(DISTINCT category)) AS categories FROM t WHERE rank <= 10 GROUP BY 1", "p")
def rc2_popular(s: S, d: D) -> DataFrame:
    """Also WN5."""
    return leaderboard.popular(items(s, d), liked(s, d), AS_OF, 10)


@query(f"""SELECT i.item_id, round(CAST(count(x.item_id) FILTER (WHERE x.feedback_type = 'like') * 3 + count(x.item_id) AS DOUBLE) / (1 + datediff('microsecond', i.timestamp, {T0}) / 3.6e9), 6) AS score
FROM i LEFT JOIN (SELECT * FROM m WHERE timestamp <= {T0}) x ON x.item_id = i.item_id WHERE NOT i.is_hidden AND i.timestamp IS NOT NULL GROUP BY i.item_id, i.timestamp HAVING count(x.item_id) > 2""", "i", "m")
def pr9_expressions(s: S, d: D) -> DataFrame:
    rows = merged(s, d).where(F.col("timestamp") <= F.lit(AS_OF).cast("timestamp_ntz")).select("item_id", "feedback_type", "value", "timestamp")
    score = "(count(feedback, .FeedbackType == 'like') * 3 + len(feedback)) / (1 + (now() - item.Timestamp).Hours())"
    scored = leaderboard.scored_items(items(s, d).where("timestamp is not null"), rows, AS_OF, score, "len(feedback) > 2")
    return scored.select("item_id", F.round("score", 6).alias("score"))


@query("SELECT item_id, CAST(epoch_us(timestamp) // 1000000 AS DOUBLE) AS score FROM i WHERE NOT is_hidden AND timestamp IS NOT NULL ORDER BY timestamp DESC, item_id LIMIT 100", "i")
def rc1_latest(s: S, d: D) -> DataFrame:
    return leaderboard.latest(items(s, d), 100)


@query("SELECT user_id, max(updated) AS last_modified FROM m GROUP BY 1", "m")
def st7_last_modified(s: S, d: D) -> DataFrame:
    return I.last_modified(merged(s, d), "user_id")


@query(f"SELECT user_id FROM m GROUP BY 1 HAVING max(timestamp) >= {T0} - INTERVAL 7 DAY", "m")
def rc25_active_users(s: S, d: D) -> DataFrame:
    return I.active_users(merged(s, d), AS_OF, 7)


@query("SELECT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM p)", "p")
def rc16_cold_users(s: S, d: D) -> DataFrame:
    return recommend.cold_users(users(s, d), classified(s, d))


_PAIR = """v AS (SELECT t.id, t.token, w.idf FROM t JOIN (SELECT token, greatest(ln(n.n / count(*)), 0.001) AS idf FROM t, n GROUP BY token, n.n) w USING (token)),
z AS (SELECT id, count(*) AS size, sum(idf) AS idf FROM v GROUP BY id),
g AS (SELECT a.id AS a, b.id AS b, sum(a.idf) AS ci, count(*) AS c FROM v a JOIN v b ON a.token = b.token AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT a, b, CASE WHEN c = x.size AND c = y.size THEN 0 ELSE 1 - ci * c / (sqrt(x.idf) * sqrt(y.idf) * (c + 100)) END AS distance FROM g JOIN z x ON x.id = a JOIN z y ON y.id = b)"""
_RANK = "r AS (SELECT a AS id, b AS neighbour, round(1 / (1 + distance), 6) AS score FROM e WHERE distance > 0 {hide}), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM r)"
_SHOWN = "AND b NOT IN (SELECT item_id FROM i WHERE is_hidden)"


def _neighbour_sql(tokens: str, owners: str, hide: str = "") -> str:
    return f"WITH t AS ({tokens}), n AS (SELECT count(*) AS n FROM {owners}), {_PAIR}, {_RANK.format(hide=hide)} SELECT id, neighbour, score, rank FROM k WHERE rank <= 10"


def _hidden(s: S, d: D) -> DataFrame:
    return items(s, d).where("is_hidden").select(F.col("item_id").alias("id"))


def _user_tokens(s: S, d: D) -> DataFrame:
    return liked(s, d).select(F.col("item_id").alias("id"), F.col("user_id").alias("token"))


@query(_neighbour_sql("SELECT item_id AS id, unnest(tags) AS token FROM i", "i", _SHOWN), "i")
def rc4_items_by_tags(s: S, d: D) -> DataFrame:
    """Also DI2, RC8 and RC9."""
    return _tag_neighbours(s, d)


def _tag_neighbours(s: S, d: D) -> DataFrame:
    tokens = item_tags(s, d)
    return similarity.token_neighbours(tokens, features.idf(tokens, items(s, d).count()), 10, _hidden(s, d))


@query(_neighbour_sql("SELECT item_id AS id, user_id AS token FROM p", "i", _SHOWN), "p")
def rc5_items_by_users(s: S, d: D) -> DataFrame:
    tokens = _user_tokens(s, d)
    return similarity.token_neighbours(tokens, features.idf(tokens, items(s, d).count()), 10, _hidden(s, d))


@query(_neighbour_sql("SELECT user_id AS id, item_id AS token FROM p", "u"), "p")
def rc10_users_by_items(s: S, d: D) -> DataFrame:
    """Also RC11."""
    return _user_neighbours(s, d)


def _user_neighbours(s: S, d: D) -> DataFrame:
    tokens = liked(s, d).select(F.col("user_id").alias("id"), F.col("item_id").alias("token"))
    return similarity.token_neighbours(tokens, features.idf(tokens, users(s, d).count()), 10)


_AUTO = f"""WITH tt AS (SELECT item_id AS id, unnest(tags) AS token FROM i), tu AS (SELECT item_id AS id, user_id AS token FROM p), n AS (SELECT count(*) AS n FROM i),
et AS (WITH t AS (SELECT * FROM tt), {_PAIR} SELECT * FROM e), eu AS (WITH t AS (SELECT * FROM tu), {_PAIR} SELECT * FROM e),
f AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, x.distance AS dt, y.distance AS du FROM et x FULL JOIN eu y ON x.a = y.a AND x.b = y.b),
e AS (SELECT a, b, (coalesce(dt, CASE WHEN a NOT IN (SELECT id FROM tt) AND b NOT IN (SELECT id FROM tt) THEN 0 ELSE 1 END) + coalesce(du, CASE WHEN a NOT IN (SELECT id FROM tu) AND b NOT IN (SELECT id FROM tu) THEN 0 ELSE 1 END)) / 2 AS distance FROM f),
{_RANK.format(hide=_SHOWN)} SELECT id, neighbour, score, rank FROM k WHERE rank <= 10"""


@query(_AUTO, "p")
def rc6_items_auto(s: S, d: D) -> DataFrame:
    total, kinds = items(s, d).count(), [item_tags(s, d), _user_tokens(s, d)]
    return similarity.shared_token_neighbours([(t, features.idf(t, total)) for t in kinds], 10, _hidden(s, d))


_VEC = """v AS (SELECT trim(item_id) AS id, min(vector)::DOUBLE[] AS x FROM item_embeddings WHERE len(vector) = 64 AND trim(item_id) <> '' AND len(list_filter(vector, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0
  AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"""


@query(f"""WITH {_VEC}, h AS (SELECT a.id, b.id AS neighbour, round(list_distance(a.x, b.x), 6) AS distance FROM v a, v b WHERE a.id <> b.id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM h WHERE distance > 0) SELECT * FROM k WHERE rank <= 5""")
def rc3_items_by_vectors(s: S, d: D) -> DataFrame:
    """Also JN8 and AN2."""
    return similarity.vector_neighbours(vectors(s, d), 5)


@query(f"WITH {_VEC}, q AS (SELECT x AS q FROM v ORDER BY id LIMIT 1) SELECT id, round(1 - list_inner_product(x, q) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(q, q))), 6) AS cosine, round(-list_inner_product(x, q), 6) AS dot FROM v, q")
def di4_metrics(s: S, d: D) -> DataFrame:
    """Also DI3 and MD3."""
    rows = vectors(s, d)
    q = F.array(*[F.lit(float(x)) for x in rows.orderBy("id").first()["vector"]])
    return rows.select("id", F.round(METRICS["cosine"](F.col("vector"), q), 6).alias("cosine"), F.round(METRICS["dot"](F.col("vector"), q), 6).alias("dot"))


_II = f"t AS (SELECT item_id AS id, unnest(tags) AS token FROM i), n AS (SELECT count(*) AS n FROM i), {_PAIR}, {_RANK.format(hide=_SHOWN)}, nb AS (SELECT id, neighbour, score FROM k WHERE rank <= 10)"
_I2I = f"""{_II}, i0 AS (SELECT p.user_id, nb.neighbour AS item_id, round(sum(nb.score), 6) AS score FROM p JOIN nb ON nb.id = p.item_id GROUP BY 1, 2),
i1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM i0 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = i0.user_id AND c.item_id = i0.item_id))"""


def _item_lists(s: S, d: D) -> DataFrame:
    return recommend.item_to_item_candidates(liked(s, d), _tag_neighbours(s, d), 20, seen=classified(s, d))


@query(f"WITH {_I2I} SELECT user_id, item_id, score, rank FROM i1 WHERE rank <= 20", "p")
def rc15_item_to_item(s: S, d: D) -> DataFrame:
    """Also JN4, JN5 and AG12."""
    return _item_lists(s, d)


@query("""WITH w AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id) AS INTEGER) AS rn FROM p) SELECT user_id, item_id, timestamp FROM w WHERE rn <= 5""", "p")
def wn7_latest_context(s: S, d: D) -> DataFrame:
    """Also WN6."""
    return recommend.latest_positives(liked(s, d), 5).select("user_id", "item_id", "timestamp")


@query(f"""WITH t AS (SELECT user_id AS id, item_id AS token FROM p), n AS (SELECT count(*) AS n FROM u), {_PAIR}, {_RANK.format(hide='')},
u0 AS (SELECT k.id AS user_id, p.item_id, round(sum(k.score), 6) AS score FROM k JOIN p ON p.user_id = k.neighbour WHERE k.rank <= 10 GROUP BY 1, 2),
u1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM u0 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = u0.user_id AND c.item_id = u0.item_id))
SELECT user_id, item_id, score, rank FROM u1 WHERE rank <= 20 AND item_id IN (SELECT item_id FROM i WHERE NOT is_hidden)""", "p")
def rc14_user_to_user(s: S, d: D) -> DataFrame:
    """Also JN6 and JN7."""
    return recommend.user_to_user_candidates(_user_neighbours(s, d), liked(s, d), 20, items(s, d), seen=classified(s, d))


_LATEST = "b AS (SELECT item_id, CAST(epoch_us(timestamp) // 1000000 AS DOUBLE) AS score FROM i WHERE NOT is_hidden AND timestamp IS NOT NULL ORDER BY timestamp DESC, item_id LIMIT 15)"
_LISTED = f"""{_LATEST}, b1 AS (SELECT u.user_id, b.item_id, b.score, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY b.score DESC, b.item_id) AS INTEGER) AS rank FROM u, b
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = u.user_id AND c.item_id = b.item_id))"""


@query(f"""WITH {_I2I}, {_LISTED}, a AS (SELECT user_id, item_id, score, 0 AS source, rank AS r FROM i1 WHERE rank <= 20 UNION ALL SELECT user_id, item_id, score, 1, rank FROM b1),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY source, r) AS o FROM a), x AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY source, r, item_id) AS INTEGER) AS rank FROM f WHERE o = 1)
SELECT user_id, item_id, score, CAST(source AS INTEGER) AS source, rank FROM x WHERE rank <= 20""", "p")
def se1_sequential(s: S, d: D) -> DataFrame:
    """Also RC17 with a fallback."""
    fallback = recommend.list_candidates(users(s, d), leaderboard.latest(items(s, d), 15), 15, classified(s, d))
    return recommend.sequential([_item_lists(s, d), fallback], 20)


@query(f"WITH {_LISTED.replace(' LIMIT 15', '')} SELECT user_id, item_id, score, CAST(rank - 3 AS INTEGER) + 3 AS rank FROM b1 WHERE rank > 3 AND rank <= 8", "p")
def qp2_latest_page(s: S, d: D) -> DataFrame:
    return recommend.latest_page(leaderboard.latest(items(s, d)), users(s, d), classified(s, d), 3, 5)


@query("""WITH last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, subset, id ORDER BY timestamp DESC NULLS LAST, score DESC NULLS LAST, coalesce(is_hidden, false) DESC, coalesce(array_to_string(categories, ','), '') DESC) AS rn FROM scores) WHERE rn = 1),
x AS (SELECT subset AS user_id, id AS item_id, score, CAST(row_number() OVER (PARTITION BY subset ORDER BY score DESC, id) AS INTEGER) AS rank FROM last WHERE collection = 'recommend' AND NOT coalesce(is_hidden, false) AND score IS NOT NULL AND NOT isnan(score)
  AND subset IN (SELECT user_id FROM u) AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = subset AND c.item_id = id AND c.kind = 'read'))
SELECT * FROM x WHERE rank > 2 AND rank <= 12""", "c")
def qp1_search(s: S, d: D) -> DataFrame:
    """Also WN13 and QP3."""
    from skein.operators.cache import latest_scores

    rows = latest_scores(table(s, d, "scores")).where("score is not null and not isnan(score)")
    return recommend.search(rows, "recommend", users(s, d), classified(s, d).where("kind = 'read'"), 2, 10)


@query(f"""WITH {_I2I}, a AS (SELECT user_id, item_id, score FROM i1 WHERE rank <= 20 UNION ALL SELECT user_id, item_id, 0.0 FROM c WHERE kind <> 'negative'),
x AS (SELECT a.user_id, a.item_id, round(a.score * CASE WHEN c.kind = 'positive' THEN 0.8 WHEN c.kind = 'read' THEN 0.6 ELSE 1.0 END, 6) AS score FROM a LEFT JOIN c USING (user_id, item_id))
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM x""", "p")
def rc21_decayed(s: S, d: D) -> DataFrame:
    """Also SE5."""
    kinds = classified(s, d)
    return recommend.decayed(recommend.with_replacement(_item_lists(s, d), kinds), kinds)


@query(f"""WITH {_II}, e0 AS (SELECT user_id AS session_id, item_id, max(timestamp) AS timestamp FROM c WHERE kind <> 'negative' AND timestamp >= TIMESTAMP '2014-02-09 00:00:00' GROUP BY 1, 2),
e1 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, item_id) AS rn FROM e0 WHERE item_id IN (SELECT id FROM nb)),
s0 AS (SELECT session_id, nb.neighbour AS item_id, round(sum(nb.score), 6) AS score FROM e1 JOIN nb ON nb.id = e1.item_id WHERE rn <= 5 GROUP BY 1, 2)
SELECT * FROM (SELECT session_id, item_id, score, CAST(row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s0
  WHERE NOT EXISTS (SELECT 1 FROM e0 WHERE e0.session_id = s0.session_id AND e0.item_id = s0.item_id)) WHERE rank <= 10""", "p")
def rc22_session(s: S, d: D) -> DataFrame:
    recent = classified(s, d).where((F.col("kind") != "negative") & (F.col("timestamp") >= F.lit("2014-02-09 00:00:00").cast("timestamp_ntz"))).select(F.col("user_id").alias("session_id"), "item_id", "timestamp")
    return recommend.session(recent, _tag_neighbours(s, d), 10, 5)


@query(f"""WITH h AS (SELECT user_id, item_id, feedback_type, value, CAST(timestamp AS DATE) AS day FROM m WHERE timestamp <= {T0} AND CAST(timestamp AS DATE) > DATE '2014-02-10' - 30),
r AS (SELECT DISTINCT user_id, item_id, day FROM h WHERE feedback_type = 'view'),
g AS (SELECT DISTINCT user_id, item_id, 'like' AS feedback_type FROM h WHERE feedback_type = 'like' UNION SELECT DISTINCT user_id, item_id, 'star>=3' FROM h WHERE feedback_type = 'star' AND value >= 3
  UNION SELECT DISTINCT user_id, item_id, '' FROM h WHERE feedback_type = 'like' OR feedback_type = 'star' AND value >= 3),
x AS (SELECT r.day, o.feedback_type, r.user_id, count(*) AS reads, count(g.user_id) AS hits FROM r JOIN (SELECT DISTINCT user_id, feedback_type FROM g) o ON o.user_id = r.user_id
  LEFT JOIN g ON g.user_id = r.user_id AND g.item_id = r.item_id AND g.feedback_type = o.feedback_type GROUP BY 1, 2, 3)
SELECT CAST(day AS VARCHAR) AS day, feedback_type, round(avg(hits / reads), 6) AS ratio FROM x GROUP BY x.day, 2""", "m")
def ag14_online_ratio(s: S, d: D) -> DataFrame:
    """Also ST2 as a batch and SE3."""
    return evaluate.online_ratio(merged(s, d), ["view"], ["like", "star>=3"], AS_OF).withColumn("day", F.col("day").cast("string"))


_VALUES = "(SELECT feedback_type AS key, value AS x FROM m)"


@query(f"""WITH v AS {_VALUES}, l AS (SELECT key, list_sort(list(x)) AS l, count(*) AS n FROM v GROUP BY key)
SELECT key, (l[CAST(n // 2 AS BIGINT) + 1] + l[CAST((n - 1) // 2 AS BIGINT) + 1]) / 2 AS median, l[CAST(n // 4 AS BIGINT) + 1] AS q1, l[CAST(3 * n // 4 AS BIGINT) + 1] AS q3,
  CASE WHEN l[CAST(3 * n // 4 AS BIGINT) + 1] = l[CAST(n // 4 AS BIGINT) + 1] THEN 1.0 ELSE l[CAST(3 * n // 4 AS BIGINT) + 1] - l[CAST(n // 4 AS BIGINT) + 1] END AS iqr FROM l""", "m")
def ag15_robust_scaler(s: S, d: D) -> DataFrame:
    return features.robust_fit(merged(s, d), "feedback_type", "value")


@query(f"SELECT key, min(x) AS low, max(x) AS high FROM {_VALUES} GROUP BY key", "m")
def ag16_minmax_scaler(s: S, d: D) -> DataFrame:
    return features.minmax_fit(merged(s, d), "feedback_type", "value")


@query(f"""WITH v AS (SELECT * FROM m), l AS (SELECT feedback_type, list_sort(list(value)) AS l, count(*) AS n, min(value) < 0 AS neg FROM v GROUP BY 1),
f AS (SELECT feedback_type, neg, (l[CAST(n // 2 AS BIGINT) + 1] + l[CAST((n - 1) // 2 AS BIGINT) + 1]) / 2 AS median, CASE WHEN l[CAST(3 * n // 4 AS BIGINT) + 1] = l[CAST(n // 4 AS BIGINT) + 1] THEN 1.0 ELSE l[CAST(3 * n // 4 AS BIGINT) + 1] - l[CAST(n // 4 AS BIGINT) + 1] END AS iqr FROM l),
x AS (SELECT v.feedback_type, user_id, item_id, CASE WHEN neg THEN (value - median) / iqr ELSE ln(1 + greatest(value, 0)) END AS x FROM v JOIN f USING (feedback_type)),
w AS (SELECT feedback_type, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)
SELECT feedback_type, user_id, item_id, round(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM x JOIN w USING (feedback_type)""", "m")
def ag17_auto_scaler(s: S, d: D) -> DataFrame:
    return features.auto_scaled(merged(s, d).select("feedback_type", "user_id", "item_id", "value"), "feedback_type", "value").select("feedback_type", "user_id", "item_id", F.round("scaled", 6).alias("scaled"))


@query(f"SELECT key, count(*) FILTER (WHERE x <> 1) > 0 AS numeric FROM {_VALUES} GROUP BY key", "m")
def ag18_numeric_features(s: S, d: D) -> DataFrame:
    return features.numeric_features(merged(s, d), "feedback_type", "value")


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS index, count(*) AS freq FROM p GROUP BY item_id", "p")
def jn1_item_index(s: S, d: D) -> DataFrame:
    return features.dictionary(liked(s, d), "item_id")


def _train_test(s: S, d: D) -> tuple[DataFrame, DataFrame]:
    edge = F.lit(TEST_FROM).cast("timestamp_ntz")
    return liked(s, d).where(F.col("timestamp") < edge), liked(s, d).where(F.col("timestamp") >= edge)


_TT = f"tr AS (SELECT * FROM p WHERE timestamp < TIMESTAMP '{TEST_FROM}'), te AS (SELECT * FROM p WHERE timestamp >= TIMESTAMP '{TEST_FROM}')"


@query(f"""WITH {_TT}, b AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM tr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
l AS (SELECT * FROM (SELECT u.user_id, b.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY b.score DESC, b.item_id) AS rank FROM u, b WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = u.user_id AND tr.item_id = b.item_id)) WHERE rank <= 10),
h AS (SELECT l.user_id, l.rank, CASE WHEN te.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM l LEFT JOIN te ON te.user_id = l.user_id AND te.item_id = l.item_id),
y AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS upto FROM h),
z AS (SELECT user_id, count(*) AS n, sum(hit) AS hits, sum(hit / log2(rank + 1)) AS dcg, sum(hit * upto / rank) AS ap, min(CASE WHEN hit = 1 THEN rank END) AS first FROM y GROUP BY 1),
t AS (SELECT user_id, count(*) AS k FROM te GROUP BY 1), q AS (SELECT k, (SELECT sum(1 / log2(j + 1)) FROM range(1, least(k, 10) + 1) r(j)) AS ideal FROM (SELECT DISTINCT k FROM t))
SELECT count(*) AS users, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, round(avg(coalesce(hits / n, 0)), 6) AS precision, round(avg(coalesce(hits, 0) / t.k), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hr,
  round(avg(coalesce(ap, 0) / t.k), 6) AS map, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM t LEFT JOIN z USING (user_id) JOIN q ON q.k = t.k""", "p")
def ag19_ranking_metrics(s: S, d: D) -> DataFrame:
    train, test = _train_test(s, d)
    board = train.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    lists = recommend.list_candidates(users(s, d), board, 50, train).where("rank <= 10")
    m = evaluate.ranking_metrics(lists, test.select("user_id", "item_id"), 10)
    return m.select("users", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "recall", "hr", "map", "mrr")])


_PRED = "pr AS (SELECT c.user_id, c.item_id, CAST(CASE WHEN kind = 'positive' THEN 1 ELSE -1 END AS INTEGER) AS target, coalesce(f.n, 0) - 40 AS score FROM c LEFT JOIN (SELECT item_id, count(*) AS n FROM p GROUP BY 1) f USING (item_id))"


def _predictions(s: S, d: D) -> DataFrame:
    """A score that SQL can make as well: how often the item was liked, less 40."""
    freq = liked(s, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return I.samples(classified(s, d)).join(freq, "item_id", "left").withColumn("score", (F.coalesce("n", F.lit(0)) - 40).cast("double"))


@query(f"""WITH {_PRED} SELECT coalesce(round(count(*) FILTER (WHERE target > 0 AND score > 0) / nullif(count(*) FILTER (WHERE score > 0), 0), 6), 0) AS precision, coalesce(round(count(*) FILTER (WHERE target > 0 AND score > 0) / nullif(count(*) FILTER (WHERE target > 0), 0), 6), 0) AS recall,
round(count(*) FILTER (WHERE target > 0 AND score > 0 OR target < 0 AND score < 0) / count(*), 6) AS accuracy FROM pr""", "p")
def ag20_click_metrics(s: S, d: D) -> DataFrame:
    return evaluate.click_metrics(_predictions(s, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


_TALLY = "SELECT {g} score, count(*) FILTER (WHERE target > 0) AS p, count(*) FILTER (WHERE target < 0) AS n FROM pr GROUP BY {g} score"


@query(f"WITH {_PRED}, t AS ({_TALLY.format(g='')}), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) SELECT round(sum(p * below) / (sum(p) * sum(n)), 6) AS auc FROM b", "p")
def ag21_auc(s: S, d: D) -> DataFrame:
    return evaluate.auc(_predictions(s, d)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_PRED} SELECT round(sqrt(avg((score - target) * (score - target))), 6) AS rmse FROM pr", "p")
def ag22_rmse(s: S, d: D) -> DataFrame:
    return evaluate.rmse(_predictions(s, d)).select(F.round("rmse", 6).alias("rmse"))


@query(f"""WITH {_PRED}, {_TT}, t AS ({_TALLY.format(g='user_id,')}), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
g AS (SELECT user_id, sum(p * below) / (sum(p) * sum(n)) AS auc, sum(p) + sum(n) AS n FROM b GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0)
SELECT round(sum(auc * n) / sum(n), 6) AS gauc, count(*) AS users FROM g WHERE user_id IN (SELECT user_id FROM tr GROUP BY 1 HAVING count(*) <= 50)""", "p")
def ag23_gauc(s: S, d: D) -> DataFrame:
    return evaluate.gauc(_predictions(s, d), _train_test(s, d)[0], 50).select(F.round("gauc", 6).alias("gauc"), "users")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id) AS rn FROM p) SELECT user_id, item_id, CASE WHEN rn = 1 THEN 'test' ELSE 'train' END AS part FROM r WHERE rn <= 4", "p")
def wn10_latest_split(s: S, d: D) -> DataFrame:
    return evaluate.latest_split(liked(s, d), 3).select("user_id", "item_id", "part")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM c)
SELECT user_id, item_id, rn <= CASE WHEN n > 1 THEN least(greatest(CAST(floor(n * 0.2) AS BIGINT), 1), n - 1) ELSE 0 END AS is_test FROM r""", "c")
def wn12_split_by_user_time(s: S, d: D) -> DataFrame:
    return evaluate.split_by_user_time(I.samples(classified(s, d))).select("user_id", "item_id", "is_test")


_DRAWN = "md5('0/' || user_id || '/' || item_id)"


@query(f"SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {_DRAWN}, item_id) = 1 AS is_test FROM p", "p")
def wn9_leave_one_out(s: S, d: D) -> DataFrame:
    return evaluate.leave_one_out(liked(s, d)).select("user_id", "item_id", "is_test")


@query(f"""WITH t AS (SELECT user_id FROM p GROUP BY 1 ORDER BY md5('0/' || user_id), user_id LIMIT 100)
SELECT user_id, item_id, user_id IN (SELECT user_id FROM t) AND row_number() OVER (PARTITION BY user_id ORDER BY {_DRAWN}, item_id) = 1 AS is_test FROM p""", "p")
def wn9_test_users(s: S, d: D) -> DataFrame:
    return evaluate.leave_one_out(liked(s, d), test_users=100).select("user_id", "item_id", "is_test")


@query(f"SELECT user_id, item_id, row_number() OVER (ORDER BY {_DRAWN}) <= CAST(floor((SELECT count(*) FROM c) * 0.2) AS BIGINT) AS is_test FROM c", "c")
def wn11_random_split(s: S, d: D) -> DataFrame:
    return evaluate.random_split(I.samples(classified(s, d))).select("user_id", "item_id", "is_test")


@query()
def wn14_negatives(s: S, d: D) -> DataFrame:
    return evaluate.sample_negatives(users(s, d), items(s, d), classified(s, d), 20)


def factors(s: S, d: D, side: str) -> DataFrame:
    rows = table(s, d, "latent_factors").where(F.col("side") == side).select(clean_id("id").alias("id"), F.col("data").alias("vector")).where("id is not null and size(vector) = 48")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("vector").alias("vector"))


_FAC = """{n} AS (SELECT trim(id) AS id, min(data)::DOUBLE[] AS x FROM latent_factors WHERE side = '{side}' AND len(data) = 48 AND trim(id) <> '' AND len(list_filter(data, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0
  AND len(list_filter(data, lambda x: x <> 0)) > 0 GROUP BY 1)"""


@query(f"""WITH {_FAC.format(n='fu', side='user')}, {_FAC.format(n='fi', side='item')}, h AS (SELECT fu.id AS user_id, fi.id AS item_id, round(list_inner_product(fu.x, fi.x), 6) AS score FROM fu, fi WHERE fi.id IN (SELECT item_id FROM i WHERE NOT is_hidden)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = h.user_id AND p.item_id = h.item_id)) SELECT * FROM k WHERE rank <= 10""", "p")
def rc12_inner_product(s: S, d: D) -> DataFrame:
    """Also JN9."""
    return recommend.inner_product_candidates(factors(s, d, "user"), factors(s, d, "item"), 10, liked(s, d), items(s, d))


@query("""WITH last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, subset, id ORDER BY timestamp DESC NULLS LAST, score DESC NULLS LAST, coalesce(is_hidden, false) DESC, coalesce(array_to_string(categories, ','), '') DESC) AS rn FROM scores) WHERE rn = 1),
x AS (SELECT subset AS user_id, id AS item_id, score, CAST(row_number() OVER (PARTITION BY subset ORDER BY score DESC, id) AS INTEGER) AS rank FROM last WHERE collection = 'collaborative-filtering' AND NOT coalesce(is_hidden, false) AND score IS NOT NULL AND NOT isnan(score)
  AND subset IN (SELECT user_id FROM u) AND list_contains(categories, 'home') AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = subset AND c.item_id = id AND c.kind = 'read'))
SELECT * FROM x WHERE rank <= 10""", "c")
def qp4_collaborative(s: S, d: D) -> DataFrame:
    from skein.operators.cache import latest_scores

    rows = latest_scores(table(s, d, "scores")).where("score is not null and not isnan(score)")
    return recommend.search(rows, "collaborative-filtering", users(s, d), classified(s, d).where("kind = 'read'"), 0, 10, ["home"])


@query(f"""WITH n AS (SELECT count(*) AS n FROM u) SELECT u.user_id, least(20, (SELECT count(*) FROM i) - coalesce(k.n, 0)) AS drawn, 0 AS known
FROM u LEFT JOIN (SELECT user_id, count(*) AS n FROM c GROUP BY 1) k ON k.user_id = u.user_id WHERE (SELECT count(*) FROM i) > coalesce(k.n, 0)""", "c")
def wn14_negative_counts(s: S, d: D) -> DataFrame:
    """How many distinct negatives each user gets, and how many of them are known."""
    kinds = classified(s, d)
    drawn = evaluate.sample_negatives(users(s, d), items(s, d), kinds, 20).join(kinds.select("user_id", "item_id", F.lit(1).alias("k")), ["user_id", "item_id"], "left")
    return drawn.groupBy("user_id").agg(F.count_distinct("item_id").alias("drawn"), F.count("k").alias("known"))


@query(f"""WITH {_VEC}, h AS (SELECT a.id, b.id AS neighbour, round(1 - list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 6) AS distance FROM v a, v b WHERE a.id <> b.id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM h WHERE distance > 0) SELECT * FROM k WHERE rank <= 5""")
def an1_hashed_neighbours(s: S, d: D) -> DataFrame:
    return similarity.hashed_neighbours(vectors(s, d), 5)


def _top_factors(s: S, d: D, made: DataFrame) -> DataFrame:
    side = lambda k: made.where(F.col("kind") == k).select("id", "vector")
    return recommend.inner_product_candidates(side("user"), side("item"), 10, liked(s, d), items(s, d))


@query()
def md2_als_candidates(s: S, d: D) -> DataFrame:
    from skein.models.factorization import als

    return _top_factors(s, d, als(liked(s, d).select("user_id", "item_id")))


@query()
def md1_bpr_candidates(s: S, d: D) -> DataFrame:
    from skein.models.factorization import bpr

    return _top_factors(s, d, bpr(liked(s, d).select("user_id", "item_id")))


def click_features(s: S, d: D) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``user_id, item_id, target, pairs`` of all samples with all labels of users and items, numbers scaled; ``id, pairs`` of their users and items; and how many positions the pairs are hashed into: at least twice the distinct features."""
    from skein.functions import labels as L
    from skein.lineage import Scratch
    from skein.models import machine

    def scaled(labels: DataFrame) -> DataFrame:
        rows = labels.where("weight is not null and not isnan(weight) and abs(weight) <> double('infinity')")
        numbers = features.numeric_features(rows, "name", "weight").where("numeric").select(F.col("key").alias("name"))
        fitted = features.auto_scaled(rows.join(numbers, "name", "left_semi"), "name", "weight")
        return rows.join(numbers, "name", "left_anti").select("id", "name", "weight").unionByName(fitted.select("id", "name", F.col("scaled").alias("weight")))

    user_labels = scaled(L.weighted(table(s, d, "users").withColumn("user_id", F.trim("user_id")), "user_id", "labels"))
    categories = items(s, d).select(F.col("item_id").alias("id"), F.explode("categories").alias("name")).withColumn("weight", F.lit(1.0))
    item_labels = scaled(L.weighted(table(s, d, "items").withColumn("item_id", F.trim("item_id")), "item_id", "labels")).unionByName(categories)
    names = [df.select("name").distinct().count() for df in (user_labels, item_labels)]
    count = users(s, d).count() + items(s, d).count() + sum(names)
    dims = max(machine.DIMS, 1 << (2 * count - 1).bit_length())
    samples = Scratch(s, "samples").cut(I.samples(classified(s, d)))
    side = lambda kind, labels: machine.side_features(samples.select(F.col(f"{kind}_id").alias("id")).distinct(), labels, kind, dims)
    return machine.hashed_features(samples, user_labels, item_labels, dims), side("user", user_labels), side("item", item_labels), dims


@query()
def md8_click_scores(s: S, d: D) -> DataFrame:
    """Also MD9, RC18, WN11 and PR13: a machine trained on four fifths of the samples scores the rest."""
    from skein.models import machine

    pairs, known_users, known_items, dims = click_features(s, d)
    split = evaluate.random_split(pairs)
    model = machine.train_fm(split.where("not is_test"), known_users, known_items, dims)
    return machine.scores(model, split.where("is_test")).select("user_id", "item_id", "target", F.round("score", 6).alias("score"))


@query("SELECT feedback_type, user_id, item_id, value, timestamp, updated FROM m", "m")
def st5_stream_merge(s: S, d: D) -> DataFrame:
    """Also ST1: the feedback files as a stream, merged batch by batch."""
    from skein.lineage import Scratch
    from skein.streaming.feedback import MergedTable, maintain, read_table

    root = Scratch(s, "stream").root
    target = MergedTable(s, f"{root}/merged")
    maintain(read_table(s, d, "feedback"), target, f"{root}/progress").awaitTermination()
    return target.load().select("feedback_type", "user_id", "item_id", "value", "timestamp", "updated")
