"""Queries of problems 4 to 10, with their SQL where SQL can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.cooccur import daily_baskets, together
from skein.llm.mixing import Mixture
from skein.llm.set_join import item_classes, similar_items
from skein.llm.subjects import document_subjects
from skein.llm.tokenizer import decode_corpus, encode_corpus
from skein.llm.top_n import standing_scores, top_n
from skein.llm.vectors import WIDE, alike_pairs, nearest, spaces
from skein.plans.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_items(table(spark, d, "items"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return item_classes(table(spark, d, "items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return together(daily_baskets(table(spark, d, "feedback"))).select("item_a", "item_b")


def p5_lift(spark: SparkSession, d: str) -> DataFrame:
    return together(daily_baskets(table(spark, d, "feedback"))).withColumn("lift", F.round("lift", 4))


def _pairs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [alike_pairs(name, v) for name, v in spaces(table(spark, d, "item_embeddings"), table(spark, d, "latent_factors")).items()]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, _pairs(spark, d))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest, however near, of the item vectors whose number is divisible by 50, among all item vectors."""
    vectors = spaces(table(spark, d, "item_embeddings"), table(spark, d, "latent_factors"))["vector"]
    asked = vectors.where("try_cast(regexp_extract(id, '[0-9]+$', 0) AS BIGINT) % 50 = 0").select("id")
    return nearest(vectors, 5, lists=WIDE, queries=asked).withColumn("cosine", F.round("cosine", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(standing_scores(table(spark, d, "scores"))).select("collection", "subset", "id")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n(standing_scores(table(spark, d, "scores")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """An exact round trip: the texts from their ids."""
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).stocks().withColumn("target_share", F.round("target_share", 6))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(*[table(spark, d, t) for t in ("documents", "subjects", "doc_subjects")])


QUERIES = {f.__name__: f for f in (p4_found, p4_classes, p5_found, p5_lift, p6_found, p6_neighbours, p7_found, p7_ranked, p8_ids, p8_decoded, p9_mix, p9_shares, p9_texts, p10_found)}

_TOP = """
WITH rows AS (SELECT collection, subset, trim(id) AS id, score, coalesce(is_hidden, false) AS hidden, timestamp FROM scores WHERE trim(id) <> ''),
last AS (SELECT *, row_number() OVER (PARTITION BY collection, subset, id ORDER BY timestamp DESC NULLS LAST, score DESC NULLS LAST, hidden DESC) AS age FROM rows),
best AS (SELECT collection, subset, id, score, row_number() OVER (PARTITION BY collection, subset ORDER BY score DESC, id) AS rank
         FROM last WHERE age = 1 AND NOT hidden AND score IS NOT NULL AND NOT isnan(score))
"""

_SETS = """
WITH t AS (SELECT DISTINCT trim(item_id) AS i, trim(lower(trim(v))) AS v
           FROM (SELECT item_id, unnest(list_concat(coalesce(categories, []), coalesce(labels.tags, []))) AS v FROM items) WHERE trim(item_id) <> '' AND trim(v) <> ''),
s AS (SELECT i, count(*) AS n FROM t GROUP BY i HAVING count(*) >= 4),
c AS (SELECT a.i AS x, b.i AS y, count(*) AS m FROM t a JOIN t b ON a.v = b.v AND a.i < b.i GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN s sx ON sx.i = x JOIN s sy ON sy.i = y WHERE 5 * m >= 3 * (sx.n + sy.n - m))
"""

_BASKETS = """
WITH b AS (SELECT DISTINCT trim(user_id) AS u, CAST(timestamp AS DATE) AS d, trim(item_id) AS i FROM feedback
           WHERE trim(user_id) <> '' AND trim(item_id) <> '' AND timestamp IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT u, d FROM b)),
m AS (SELECT i, count(*) AS c FROM b GROUP BY i),
p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.u = y.u AND x.d = y.d AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT item_a, item_b, n_ab, ma.c AS n_a, mb.c AS n_b, n.n AS n_baskets, round(n_ab / (ma.c / n.n) / mb.c, 4) AS lift
      FROM p JOIN m ma ON ma.i = item_a JOIN m mb ON mb.i = item_b, n WHERE n_ab * n.n >= 5 * ma.c * mb.c)
"""

_USABLE = "len({v}) = {n} AND trim({i}) <> '' AND len(list_filter({v}, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"

_NEAR = f"""
WITH v AS (SELECT 'vector' AS space, trim(item_id) AS id, min(vector)::DOUBLE[] AS x FROM item_embeddings WHERE {_USABLE.format(v='vector', n=64, i='item_id')} GROUP BY 1, 2
  UNION ALL SELECT trim(side), trim(id), min(data)::DOUBLE[] FROM latent_factors WHERE trim(side) IN ('user', 'item') AND {_USABLE.format(v='data', n=48, i='id')} GROUP BY 1, 2),
h AS (SELECT a.space, a.id, b.id AS other, round(list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 12) AS cosine FROM v a JOIN v b ON a.space = b.space AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY space, id ORDER BY cosine DESC, other) AS rank FROM h)
"""

SQL = {
    "p4_found": _SETS + "SELECT x AS item_a, y AS item_b FROM p",
    "p4_classes": _SETS + """,
k AS (SELECT t.i, list_sort(list(v)) AS terms FROM t JOIN s USING (i) GROUP BY t.i),
g AS (SELECT terms, min(i) AS class_id, count(*) AS class_size FROM k GROUP BY terms),
l AS (SELECT i, count(*) AS links FROM (SELECT x AS i FROM p UNION ALL SELECT y FROM p) GROUP BY i)
SELECT k.i AS item_id, class_id, class_size, coalesce(links, 0) AS links FROM k JOIN g USING (terms) LEFT JOIN l ON l.i = k.i""",
    "p5_found": _BASKETS + "SELECT item_a, item_b FROM r",
    "p5_lift": _BASKETS + "SELECT * FROM r",
    "p7_found": _TOP + "SELECT collection, subset, id FROM best WHERE rank <= 10",
    "p7_ranked": _TOP + "SELECT collection, subset, id, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 10",
    "p9_texts": r"""
WITH c AS (SELECT doc_id, text, nullif(regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g'), '') AS source FROM documents WHERE text <> ''),
t AS (SELECT mix_name, nullif(regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g'), '') AS source, sum(CASE WHEN target_share > 0 AND NOT isnan(target_share) THEN target_share ELSE 0 END) AS share,
      min(greatest(coalesce(max_repeats, 1), 0)) AS max_repeats FROM mix_targets WHERE mix_name IS NOT NULL AND trim(source) <> '' GROUP BY 1, 2),
o AS (SELECT mix_name, text, arg_min(c.source, doc_id) AS source FROM c JOIN t ON c.source = t.source AND t.share > 0 GROUP BY 1, 2),
n AS (SELECT mix_name, source, count(*) AS texts FROM o GROUP BY 1, 2)
SELECT t.mix_name, t.source, round(t.share / sum(t.share) OVER (PARTITION BY t.mix_name), 6) AS target_share, t.max_repeats, coalesce(n.texts, 0) AS texts
FROM t LEFT JOIN n ON n.mix_name = t.mix_name AND n.source = t.source""",
    "p6_found": _NEAR + """
SELECT DISTINCT space, least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE rank <= 5 AND cosine >= 0.9""",
    "p6_neighbours": _NEAR + """
SELECT id, other, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM k WHERE space = 'vector' AND rank <= 5 AND TRY_CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 50 = 0""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
