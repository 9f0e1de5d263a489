from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import evaluate, features, hot_keys, interactions, leaderboard, recommend, similarity
from skein.operators.rank import external, parse_completion, rank_by_client, render

T = dt.datetime(2014, 1, 1)


def test_classification_priority(spark, rows):
    merged = spark.createDataFrame(
        [("like", "u", "a", 1.0), ("view", "u", "a", 1.0), ("skip", "u", "a", 1.0), ("like", "u", "b", 1.0), ("view", "u", "b", 1.0), ("view", "u", "c", 1.0), ("star", "u", "d", 2.0), ("like", "x", "a", 1.0)],
        "feedback_type string, user_id string, item_id string, value double",
    ).withColumn("timestamp", F.lit("2014-01-01").cast("timestamp_ntz"))
    users, items = spark.createDataFrame([("u",)], "user_id string"), spark.createDataFrame([(i,) for i in "abcd"], "item_id string")
    c = interactions.classify(merged, users, items, "2014-01-02 00:00:00")
    assert rows(c, "item_id", "kind") == [("a", "negative"), ("b", "positive"), ("c", "read")]
    assert rows(interactions.samples(c), "item_id", "target") == [("a", -1), ("b", 1), ("c", -1)]
    assert interactions.classify(merged, users, items, "2013-12-31 00:00:00").count() == 0


def test_token_neighbours_closed_form(spark):
    """Item i has the tokens 1..20-i, each of weight 1; neighbours of an item are the nearest sizes."""
    tokens = spark.createDataFrame([(f"{i:02d}", str(t)) for i in range(20) for t in range(20 - i)], "id string, token string")
    weights = tokens.select("token").distinct().withColumns({"idf": F.lit(1.0), "freq": F.lit(1)})
    pairs = {(r["a"], r["b"]): r["distance"] for r in similarity.token_pairs(tokens, weights).collect()}
    for (a, b), d in pairs.items():
        na, nb = 20 - int(a), 20 - int(b)
        c = min(na, nb)
        assert math.isclose(d, 1 - c * c / (math.sqrt(na) * math.sqrt(nb) * (c + 100)))
    assert len(pairs) == 380


def test_equal_sets_are_pruned_and_hidden_are_no_neighbours(spark, rows):
    tokens = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("c", "y")], "id string, token string")
    weights = spark.createDataFrame([("x", 1.0, 1), ("y", 1.0, 1)], "token string, idf double, freq int")
    pairs = similarity.token_pairs(tokens, weights)
    assert rows(similarity.neighbours(pairs, 5), "id", "neighbour") == [("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")]
    hidden = spark.createDataFrame([("c",)], "id string")
    assert rows(similarity.neighbours(pairs, 5, hidden), "id", "neighbour") == [("c", "a"), ("c", "b")]
    for block in (2, 1000):
        assert rows(similarity.token_neighbours(tokens, weights, 5, block_rows=block)) == rows(similarity.neighbours(pairs, 5))
        assert rows(similarity.token_neighbours(tokens, weights, 1, hidden, block)) == rows(similarity.neighbours(pairs, 1, hidden))
    assert similarity.token_neighbours(tokens.limit(0), weights, 5).count() == 0
    auto = similarity.auto_pairs(pairs, pairs.limit(0), tokens, tokens.limit(0))
    got = {(r["a"], r["b"]): r["distance"] for r in auto.collect()}
    want = {(r["a"], r["b"]): r["distance"] / 2 for r in pairs.collect()}
    assert got == want


def test_vector_neighbours_closed_form(spark):
    vectors = spark.createDataFrame([(f"{i:03d}", [0.1 * i, 0.2 * i, 0.3 * i]) for i in range(100)], "id string, vector array<float>")
    near = similarity.vector_neighbours(vectors, 10, blocks=3).where("id = '000'").orderBy("rank").collect()
    assert [r["neighbour"] for r in near] == [f"{i:03d}" for i in range(1, 11)]
    assert similarity.vector_neighbours(vectors.limit(0), 10).count() == 0


@pytest.mark.parametrize("bucket", [30, 4000])
def test_hashed_neighbours_recall(spark, bucket):
    """3,000 vectors without clusters, so most neighbours are far; 30 a bucket makes patterns of 7 signs, 4,000 a single bucket."""
    x = np.random.default_rng(4).normal(size=(3000, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    want = {(f"{i:04d}", f"{j:04d}") for i, top in enumerate(np.argsort(-near, axis=1)[:, :5]) for j in top}
    got = similarity.hashed_neighbours(vectors, 5, bucket_rows=bucket).collect()
    assert len({(r["id"], r["rank"]) for r in got}) == len(got) == 15000
    found = len(want & {(r["id"], r["neighbour"]) for r in got}) / len(want)
    assert found > (0.95 if bucket == 30 else 0.9999)


def test_leaderboard(spark, rows):
    items = spark.createDataFrame([(f"i{k:02d}", k == 9, ["even"] if k % 2 == 0 else ["odd"], T) for k in range(10)], "item_id string, is_hidden boolean, categories array<string>, timestamp timestamp_ntz")
    fb = spark.createDataFrame([(f"i{k:02d}", "like", 1.0) for k in range(10) for _ in range(k)], "item_id string, feedback_type string, value double")
    board = leaderboard.popular(items, fb, "2014-01-02 00:00:00", 2)
    assert rows(board) == [("i05", 5.0, ["odd"]), ("i06", 6.0, ["even"]), ("i07", 7.0, ["", "odd"]), ("i08", 8.0, ["", "even"])]
    few = leaderboard.scored_items(items, fb, "2014-01-02 00:00:00", "len(feedback)", "len(feedback) < 2 and item.ItemId != 'i00'")
    assert rows(few, "item_id") == [("i01",)]
    with pytest.raises(TypeError):
        leaderboard.scored_items(items, fb, "2014-01-02 00:00:00", "item.ItemId")


def test_sequential_union(spark, rows):
    lst = lambda *r: spark.createDataFrame([("u", i, s, n) for n, (i, s) in enumerate(r, 1)], "user_id string, item_id string, score double, rank int")
    got = recommend.sequential([lst(("a", 1.0), ("b", 0.5)), lst(("b", 9.0), ("c", 8.0), ("d", 7.0))], 3, spark.createDataFrame([("u", "a")], "user_id string, item_id string"))
    assert rows(got, "item_id", "source", "rank") == [("b", 0, 1), ("c", 1, 2), ("d", 1, 3)]


def test_decay_of_replaced_items(spark, rows):
    cands = spark.createDataFrame([("u", str(i), float(10 - i)) for i in range(6)], "user_id string, item_id string, score double")
    kinds = spark.createDataFrame([("u", "0", "positive"), ("u", "1", "read")], "user_id string, item_id string, kind string")
    got = recommend.decayed(cands, kinds)
    assert [(r["item_id"], r["score"]) for r in got.orderBy("rank").collect()] == [("0", 8.0), ("2", 8.0), ("3", 7.0), ("4", 6.0), ("1", 5.4), ("5", 5.0)]


def test_session(spark, rows):
    near = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.5), ("b", "y", 0.7), ("c", "z", 0.9)], "id string, neighbour string, score double")
    recent = spark.createDataFrame([("s", "c", T), ("s", "b", T + dt.timedelta(1)), ("s", "q", T + dt.timedelta(3)), ("s", "a", T + dt.timedelta(2))], "session_id string, item_id string, timestamp timestamp_ntz")
    assert rows(recommend.session(recent, near, 5, 2), "item_id", "score", "rank") == [("x", 1.5, 1), ("y", 0.7, 2)]


def test_ranking_metrics_golden(spark):
    lists = spark.createDataFrame([("u", str(i), i + 1) for i in range(10)], "user_id string, item_id string, rank int")
    m = evaluate.ranking_metrics(lists, spark.createDataFrame([("u", i) for i in ("1", "3", "5", "7")], "user_id string, item_id string"), 10).first()
    assert math.isclose(m["ndcg"], 0.6766372989, abs_tol=1e-9) and m["precision"] == 0.4 and m["recall"] == 1.0 and m["mrr"] == 0.5 and m["hr"] == 1.0
    none = evaluate.ranking_metrics(lists, spark.createDataFrame([("w", "1")], "user_id string, item_id string"), 10).first()
    assert none["users"] == 1 and none["ndcg"] == 0 and none["precision"] == 0


def test_click_metrics(spark):
    df = spark.createDataFrame([("u", 1, 1.0), ("u", 1, -1.0), ("u", -1, 0.0), ("u", -1, -2.0), ("u", -1, 3.0)], "user_id string, target int, score double")
    m = evaluate.click_metrics(df).first()
    assert (m["precision"], m["recall"], m["accuracy"]) == (0.5, 0.5, 0.4)
    assert math.isclose(evaluate.auc(df).first()[0], 3 / 6)
    tied = spark.createDataFrame([("u", 1, 1.0), ("u", -1, 1.0)], "user_id string, target int, score double")
    assert evaluate.auc(tied).first()[0] == 0
    train = spark.createDataFrame([("u",)], "user_id string")
    assert math.isclose(evaluate.gauc(df, train, 5).first()["gauc"], 0.5)


def test_online_ratio(spark):
    data = [("read", "1", "1"), ("read", "1", "2"), ("read", "2", "1"), ("read", "2", "2"), ("star", "1", "1"), ("star", "2", "9")]
    df = spark.createDataFrame(data, "feedback_type string, user_id string, item_id string").withColumns({"value": F.lit(1.0), "timestamp": F.lit("2014-01-01 10:00:00").cast("timestamp_ntz")})
    got = {r["feedback_type"]: r["ratio"] for r in evaluate.online_ratio(df, ["read"], ["star"], "2014-01-02 00:00:00").collect()}
    assert got == {"star": 0.25, "": 0.25}


def test_splits(spark, rows):
    pos = spark.createDataFrame([("u", f"i{k}", T + dt.timedelta(k)) for k in range(10)] + [("w", "i0", T)], "user_id string, item_id string, timestamp timestamp_ntz")
    assert rows(evaluate.latest_split(pos, 2).where("user_id = 'u'"), "item_id", "part") == [("i7", "train"), ("i8", "train"), ("i9", "test")]
    assert rows(evaluate.split_by_user_time(pos).where("is_test"), "user_id", "item_id") == [("u", "i8"), ("u", "i9")]
    one = evaluate.leave_one_out(pos)
    assert one.where("is_test").count() == 2 and rows(one) == rows(evaluate.leave_one_out(pos))
    assert evaluate.random_split(pos, 0.3).where("is_test").count() == 3 and evaluate.random_split(pos, 0.0).where("is_test").count() == 0
    items = spark.createDataFrame([(f"i{k}",) for k in range(100)], "item_id string")
    neg = evaluate.sample_negatives(pos.select("user_id").distinct(), items, pos, 5)
    assert neg.join(pos, ["user_id", "item_id"]).count() == 0 and neg.distinct().count() == neg.count() == 10


def test_negatives_are_never_short(spark):
    """Of 211 items w knows 160, x all but 7, y none, z all; of 20 items everyone gets what is left."""
    items = spark.createDataFrame([(f"i{k:03d}",) for k in range(211)], "item_id string")
    users = spark.createDataFrame([(u,) for u in "wxyz"], "user_id string")
    known = spark.createDataFrame([(u, f"i{k:03d}") for u, m in (("w", 160), ("x", 204), ("z", 211)) for k in range(m)] + [("w", "gone")], "user_id string, item_id string")
    for k, want in ((211, {"w": 20, "x": 7, "y": 20}), (20, {"y": 20})):
        neg = evaluate.sample_negatives(users, items.where(F.col("item_id") < f"i{k:03d}"), known, 20)
        assert {r["user_id"]: r["count"] for r in neg.distinct().groupBy("user_id").count().collect()} == want
        assert neg.join(known, ["user_id", "item_id"]).count() == 0 and neg.distinct().count() == neg.count()


def test_scalers(spark, rows):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 2, 4, 9, 7, 8)] + [("b", -1.0), ("b", 1.0), ("c", 2.0)], "k string, x double")
    r = {x["key"]: x for x in features.robust_fit(df, "k", "x").collect()}
    assert (r["a"]["q1"], r["a"]["q3"], r["a"]["median"]) == (3.0, 8.0, 4.5) and r["c"]["iqr"] == 1.0
    scaled = {(x["k"], x["x"]): x["scaled"] for x in features.auto_scaled(df, "k", "x").collect()}
    assert scaled["b", -1.0] == 0.0 and scaled["b", 1.0] == 1.0 and scaled["a", 9.0] == 1.0 and math.isclose(scaled["a", 3.0], math.log(2) / math.log(5))
    d = features.dictionary(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), "v")
    assert rows(d) == [("a", 0, 1), ("b", 1, 2)]


def test_clients(spark, rows):
    assert parse_completion("<think>no</think>```json\n[\"a\", \"b\"]\n```") == ["a", "b"]
    assert parse_completion("```csv\na,1\nb,2\n```") == ["a", "b"] and parse_completion("a\n\n b ") == ["a", "b"]
    assert render("{% for x in xs %}<{{ x.n }}>{% endfor %} {{ y }}", xs=[{"n": 1}, {"n": 2}], y="z") == "<1><2> z"
    prompts = spark.createDataFrame([("u", "q", ["a", "b"], ["da", "db"])], "user_id string, query string, item_ids array<string>, documents array<string>")
    assert rows(rank_by_client(prompts, lambda q, docs: [(1, 0.9), (0, 0.1)])) == [("u", "a", 0.1, 2), ("u", "b", 0.9, 1)]
    assert rows(external(spark.createDataFrame([("u",)], "user_id string"), lambda u: ["x", "y", "x"])) == [("u", "x", 0.0, 1), ("u", "y", 0.0, 2)]


@pytest.mark.parametrize(
    "text, names",
    [
        ("```json\n{\"a\": 1}\n```", ["{\"a\": 1}\n"]), ("```json\n[1, 2.0, 2.5, {\"b\": [1, null], \"a\": true}, \"x y\"]\n```", ["1", "2", "2.5", "{\"a\":true,\"b\":[1,null]}", "x y"]),
        ("```json\n[1, \n```", ["[1, \n"]), ("```\n[1]\n```\nthen\n~~~ csv\n a ,1\n\n b,2\n~~~", ["a", "b"]), ("```json\n[\"open\"]", ["open"]), ("", []),
        ("a <think>b</think>", ["a <think>b</think>"]), ("<think>b", ["<think>b"]), ("<think>```json\n[1]\n```</think> c ", ["c"]), ("```python\nx\n```", ["```python", "x", "```"]), ("```json\n[]\n```", []),
    ],
)
def test_completions(text, names):
    assert parse_completion(text) == names


def test_filled_lists_look_as_deep_as_a_user_has_seen(spark):
    users = spark.createDataFrame([("new",), ("some",), ("all",), ("most",)], "user_id string")
    board = spark.createDataFrame([(f"i{k:03d}", float(-k)) for k in range(200)], "item_id string, score double")
    seen = spark.createDataFrame([("some", f"i{k:03d}") for k in range(30)] + [("all", f"i{k:03d}") for k in range(200)] + [("most", f"i{k:03d}") for k in range(197)] + [("most", "i000")], "user_id string, item_id string")
    got = {}
    for r in recommend.filled_list(users, board, 5, seen).orderBy("rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got == {"new": [f"i{k:03d}" for k in range(5)], "some": [f"i{k:03d}" for k in range(30, 35)], "most": ["i197", "i198", "i199"]}
    page = recommend.latest_page(board, users, seen, 2, 2)
    assert {(r["user_id"], r["item_id"], r["rank"]) for r in page.collect()} == {("new", "i002", 3), ("new", "i003", 4), ("some", "i032", 3), ("some", "i033", 4), ("most", "i199", 3)}
    assert recommend.filled_list(users, board.limit(0), 5, seen).count() == 0


def test_queries_with_depths_of_their_own(spark):
    vectors = spark.createDataFrame([(f"{i:03d}", [0.1 * i, 0.2 * i]) for i in range(50)], "id string, vector array<float>")
    asking = vectors.where("id < '004'").withColumn("more", F.when(F.col("id") == "002", 30).otherwise(F.col("id").cast("int")))
    near = similarity.vector_neighbours(vectors, 3, "dot", queries=asking, blocks=2)
    assert {r["id"]: r["n"] for r in near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"000": 3, "001": 4, "002": 33, "003": 6}
    assert near.where("id = '003'").orderBy("rank").first()["neighbour"] == "049"


@pytest.mark.parametrize("cells", [4, 4_000_000])
def test_mean_of_two_kinds_of_tokens(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    rng = random.Random(3)
    kinds = []
    for k in range(2):
        held = {(f"i{rng.randrange(40):02d}", f"t{rng.randrange(12)}") for _ in range(110)}
        tokens = spark.createDataFrame(sorted(held), "id string, token string")
        kinds.append((tokens, features.idf(tokens, 40)))
    pairs = [similarity.token_pairs(*k) for k in kinds]
    want = similarity.neighbours(similarity.auto_pairs(*pairs, kinds[0][0], kinds[1][0]), 4)
    for block in (30, 10_000):
        got = similarity.shared_token_neighbours(kinds, 4, block_rows=block)
        assert rows(got, "id", "neighbour", "rank", "score") == rows(want, "id", "neighbour", "rank", "score")


def test_salted_join_is_the_plain_join(spark, rows):
    big = spark.createDataFrame([("hot" if k % 3 else f"k{k % 50}", k, "x") for k in range(6000)] + [(None, 1, "y")], "key string, n int, clash string")
    small = spark.createDataFrame([("hot", "a"), ("k0", "b"), ("k3", "c"), ("zz", "d"), (None, "e")], "key string, name string")
    for how in ("inner", "left"):
        assert rows(hot_keys.salted_join(big, small, "key", how, share=0.1, salts=4), "key", "n", "name") == rows(big.join(small, "key", how), "key", "n", "name")
    assert hot_keys.salted_join(big.limit(0), small, "key").count() == 0
