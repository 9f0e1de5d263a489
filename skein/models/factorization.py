"""Matrix factorization: alternating least squares by ``pyspark.ml``, and BPR in blocks (MD1 to MD5, MD14)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.lineage import Scratch
from skein.operators.features import dictionary

FACTORS = "kind string, id string, vector array<float>"


def als(interactions: DataFrame, factors: int = 16, iterations: int = 10, reg: float = 0.06, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``kind, id, vector`` of users and items from distinct ``user_id, item_id`` (MD2).

    ``pyspark.ml`` wants numbers below 2^31, so ids are numbered first. Only ids with an interaction have factors (MD4).
    """
    from pyspark.ml.recommendation import ALS

    scratch = Scratch(interactions.sparkSession, "als")
    users, items = (scratch.cut(dictionary(interactions, c).select(c, F.col("index").cast("int").alias(f"n_{c}"))) for c in ("user_id", "item_id"))
    rows = interactions.select("user_id", "item_id").join(users, "user_id").join(items, "item_id").withColumn("one", F.lit(1.0))
    model = ALS(rank=factors, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="n_user_id", itemCol="n_item_id", ratingCol="one", seed=seed).fit(rows)
    side = lambda kind, f, ids, c: f.join(ids, F.col("id") == F.col(f"n_{c}")).select(F.lit(kind).alias("kind"), F.col(c).alias("id"), F.col("features").alias("vector"))
    return side("user", model.userFactors, users, "user_id").unionByName(side("item", model.itemFactors, items, "item_id"))


def bpr(
    interactions: DataFrame, factors: int = 16, rounds: int = 6, epochs: int = 4, rate: float = 0.05, reg: float = 0.01, seed: int = 0, block_rows: int = 1_000_000,
    score: Callable[[DataFrame], float] | None = None, patience: int = 2,
) -> DataFrame:
    """``kind, id, vector`` by pairwise ranking (MD1).

    Users are hashed into blocks of about ``block_rows`` interactions. In a round each block runs stochastic updates
    on its users and its own copy of the items they touch, with negatives from the block; then the copies of an item
    are averaged by use. A block and the factors in it fit a task, whatever the number of users and items. With
    ``score`` the factors are scored after each round, rounds end when the best are ``patience`` rounds old, and the
    best are given (MD5).
    """
    scratch = Scratch(interactions.sparkSession, "bpr")
    rows = interactions.select("user_id", "item_id").distinct()
    blocks = max(1, -(-rows.count() // block_rows))
    rows = scratch.cut(rows.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")))
    users = rows.select("block", F.lit("user").alias("kind"), F.col("user_id").alias("id")).distinct()
    copies = rows.select("block", F.lit("item").alias("kind"), F.col("item_id").alias("id")).distinct()
    state = users.unionByName(copies).withColumn("vector", F.lit(None).cast("array<float>"))

    def train(edges: pd.DataFrame, held: pd.DataFrame, turn: int) -> pd.DataFrame:
        out = "block kind id vector uses".split()
        if not len(edges):
            return pd.DataFrame({c: [] for c in out})
        u_ids, u = np.unique(edges["user_id"].to_numpy(), return_inverse=True)
        i_ids, i = np.unique(edges["item_id"].to_numpy(), return_inverse=True)
        block = int(edges["block"].iloc[0])
        rng = np.random.default_rng([seed, turn, block])

        def start(ids: np.ndarray, kind: str) -> np.ndarray:
            own = held[held["kind"] == kind].set_index("id")["vector"].to_dict()
            m = rng.normal(0, 0.1, (len(ids), factors))
            for k, x in enumerate(ids):
                if own.get(x) is not None:
                    m[k] = own[x]
            return m

        p, q = start(u_ids, "user"), start(i_ids, "item")
        known = np.unique(u.astype(np.int64) * len(i_ids) + i)
        for _ in range(epochs):
            order = rng.permutation(len(u))
            for at in range(0, len(u), 2048):
                r = order[at : at + 2048]
                a, b, c = u[r], i[r], rng.integers(0, len(i_ids), len(r))
                pair = a.astype(np.int64) * len(i_ids) + c
                ok = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] != pair
                a, b, c = a[ok], b[ok], c[ok]
                x = (p[a] * (q[b] - q[c])).sum(axis=1)
                g = (1 / (1 + np.exp(np.clip(x, -60, 60))))[:, None]
                dp, db, dc = g * (q[b] - q[c]) - reg * p[a], g * p[a] - reg * q[b], -g * p[a] - reg * q[c]
                np.add.at(p, a, rate * dp)
                np.add.at(q, b, rate * db)
                np.add.at(q, c, rate * dc)
        uses = np.bincount(i, minlength=len(i_ids))
        return pd.DataFrame({
            "block": block, "kind": ["user"] * len(u_ids) + ["item"] * len(i_ids), "id": np.concatenate([u_ids, i_ids]),
            "vector": [v.astype(np.float32) for v in (*p, *q)], "uses": np.concatenate([np.ones(len(u_ids)), uses]),
        })

    def turned(turn: int) -> Callable:
        return lambda edges, held: train(edges, held, turn)

    def turn_of(turn: int) -> float:
        nonlocal state
        made = rows.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(turned(turn), f"block int, {FACTORS}, uses double")
        made, path = scratch.write(made)
        parts = made.where("kind = 'item'").select("id", "uses", F.posexplode("vector").alias("k", "x"))
        mean = parts.groupBy("id", "k").agg((F.sum(F.col("x") * F.col("uses")) / F.sum("uses")).cast("float").alias("x"))
        mean = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"))
        items = copies.join(mean, "id").select("block", "kind", "id", "vector")
        state, kept = scratch.write(made.where("kind = 'user'").select("block", "kind", "id", "vector").unionByName(items))
        scratch.drop(path)
        value = score(told(state)) if score else float(turn)
        if not turns or value > max(turns):
            best.append((state, kept))
            for _, old in best[:-1]:
                scratch.drop(old)  # neither the best nor what the next round starts from
            del best[:-1]
        turns.append(value)
        return value

    def told(state: DataFrame) -> DataFrame:
        return state.where("kind = 'user'").select("kind", "id", "vector").unionByName(state.where("kind = 'item'").select("kind", "id", "vector").dropDuplicates(["kind", "id"]))

    turns: list[float] = []
    best: list[tuple[DataFrame, str]] = []
    early_stopped(lambda epoch: turn_of(epoch - 1), rounds, patience if score else rounds + 1)
    return told(best[-1][0])


def predict(pairs: DataFrame, factors: DataFrame) -> DataFrame:
    """``user_id, item_id, score``: dot products; pairs of an unknown id score 0 (MD3)."""
    from skein.functions.vectors import dot

    side = lambda k, c, v: factors.where(F.col("kind") == k).select(F.col("id").alias(c), F.col("vector").alias(v))
    rows = pairs.join(side("user", "user_id", "p"), "user_id", "left").join(side("item", "item_id", "q"), "item_id", "left")
    return rows.select("user_id", "item_id", F.coalesce(dot(F.col("p"), F.col("q")), F.lit(0.0)).alias("score"))


def predictable(ids: DataFrame, interactions: DataFrame, key: str) -> DataFrame:
    """``key, predictable``: whether an id has training feedback, without which its factors mean nothing (MD4)."""
    known = interactions.select(key).distinct().withColumn("_k", F.lit(True))
    return ids.select(key).join(known, key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("predictable"))


def ndcg(factors: DataFrame, train: DataFrame, test: DataFrame, k: int = 10) -> float:
    """NDCG at ``k`` of all items that a user hasn't in ``train``, against those in ``test``."""
    from skein.operators.evaluate import ranking_metrics
    from skein.operators.recommend import inner_product_candidates

    side = lambda kind: factors.where(F.col("kind") == kind).select("id", "vector")
    items = side("item").select(F.col("id").alias("item_id"), F.lit(False).alias("is_hidden"))
    users = side("user").join(test.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    lists = inner_product_candidates(users, side("item"), k, train.select("user_id", "item_id"), items)
    return float(ranking_metrics(lists, test.select("user_id", "item_id").distinct(), k).first()["ndcg"] or 0.0)


def searched_bpr(train: DataFrame, test: DataFrame, space: dict[str, tuple | list], trials: int = 10, rounds: int = 6, patience: int = 2, seed: int = 0) -> tuple[DataFrame, dict, float]:
    """Factors, parameters and NDCG of the best of ``trials`` parameter sets, each fitted with early stopping (MD5, MD6)."""
    kept: dict[str, tuple[DataFrame, float]] = {}

    def objective(params: dict) -> float:
        made = bpr(train, rounds=rounds, patience=patience, seed=seed, score=lambda f: ndcg(f, train, test), **params)
        kept[repr(params)] = made, ndcg(made, train, test)
        return kept[repr(params)][1]

    params, value = search(space, objective, trials, seed)
    return kept[repr(params)][0], params, value


def early_stopped(step: Callable[[int], float], epochs: int, patience: int) -> tuple[int, float]:
    """Run ``step(epoch)``, which gives a score, until the best is ``patience`` epochs old (MD5)."""
    best, at = -np.inf, 0
    for epoch in range(1, epochs + 1):
        score = step(epoch)
        if score > best:
            best, at = score, epoch
        elif epoch - at >= patience:
            break
    return at, float(best)


def search(space: dict[str, tuple | list], objective: Callable[[dict], float], trials: int = 10, seed: int = 0) -> tuple[dict, float]:
    """The best of ``trials`` parameter sets (MD6). Lists are choices, (low, high) numbers a log range; after a third of
    the trials new ones are drawn near the better third, as tree-structured estimators do."""
    rng = np.random.default_rng(seed)
    seen: list[tuple[float, dict]] = []
    for t in range(trials):
        good = [p for _, p in sorted(seen, key=lambda x: -x[0])[: max(1, len(seen) // 3)]]
        params = {}
        for name, options in space.items():
            near = good[rng.integers(len(good))][name] if good and t >= trials / 3 and rng.random() < 0.7 else None
            if isinstance(options, list):
                params[name] = near if near is not None else options[rng.integers(len(options))]
            else:
                low, high = np.log(options[0]), np.log(options[1])
                x = rng.normal(np.log(near), (high - low) / 6) if near is not None else rng.uniform(low, high)
                params[name] = float(np.exp(np.clip(x, low, high)))
        seen.append((objective(params), params))
    score, params = max(seen, key=lambda x: x[0])
    return params, score
