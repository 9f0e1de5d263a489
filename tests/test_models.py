from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.models.factorization import als, bpr, early_stopped, ndcg, predict, search, searched_bpr
from skein.models.machine import AttentiveMachine, hashed_features, padded
from skein.models.tensor import Attention, Linear, Sgd, Tensor, bce_with_logits, mse, softmax_cross_entropy


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(3, 4)), rng.normal(size=(4, 2))

    def value(a, b, grads=False):
        a, b = Tensor(a), Tensor(b)
        y = ((a @ b).sigmoid() * (a @ b).exp() / 3.0 + (a * a).sum(axis=1, keepdims=True).sin() - b.abs().mean(axis=0)).softmax() ** 2
        out = y.sum()
        if grads:
            out.backward()
            return a.grad, b.grad
        return float(out.data)

    ga, gb = value(x, w, True)
    for m, g in ((x, ga), (w, gb)):
        for at in np.ndindex(m.shape):
            e = np.zeros_like(m)
            e[at] = 1e-2
            up, down = (value(x + e, w), value(x - e, w)) if m is x else (value(x, w + e), value(x, w - e))
            assert abs((up - down) / 2e-2 - g[at]) < 2e-2


def test_losses_and_layers():
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(64, 3)), np.sign(rng.normal(size=64))
    layer = Linear(3, 1, rng)
    sgd, first, last = Sgd(layer.parameters(), 0.5), None, None
    for _ in range(60):
        loss = bce_with_logits(layer(Tensor(x)).reshape(-1), t)
        loss.backward()
        sgd.step()
        first, last = first or float(loss.data), float(loss.data)
    assert last < first
    assert Attention(3, 4, rng)(Tensor(rng.normal(size=(5, 7, 3)))).shape == (5, 3)
    assert float(mse(Tensor([1.0, 2.0]), np.array([1.0, 4.0])).data) == 2.0
    assert abs(float(softmax_cross_entropy(Tensor([[0.0, 0.0]]), np.array([1])).data) - np.log(2)) < 1e-6


@pytest.fixture(scope="module")
def blocks(spark):
    """Two groups of users that each like their own half of the items."""
    return spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(30) for i in range(30) if u % 2 == i % 2 and (u * 7 + i * 3) % 5], "user_id string, item_id string")


@pytest.mark.parametrize("fit", [als, lambda df: bpr(df, 8, 3, 10, block_rows=100)])
def test_factors_separate_groups(spark, blocks, fit):
    factors = fit(blocks)
    pairs = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(30) for i in range(30)] + [("nobody", "i1")], "user_id string, item_id string")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in predict(pairs, factors).collect()}
    same = np.mean([v for (u, i), v in got.items() if u != "nobody" and int(u[1:]) % 2 == int(i[1:]) % 2])
    other = np.mean([v for (u, i), v in got.items() if u != "nobody" and int(u[1:]) % 2 != int(i[1:]) % 2])
    assert same > other + 0.1 and got["nobody", "i1"] == 0.0


def test_machine(spark):
    samples = spark.createDataFrame([(f"u{u}", f"i{i}", 1 if u % 2 == i % 2 else -1) for u in range(12) for i in range(12)], "user_id string, item_id string, target int")
    users = spark.createDataFrame([(f"u{u}", f"g{u % 2}", 1.0) for u in range(12)], "id string, name string, weight double")
    items = spark.createDataFrame([(f"i{i}", f"h{i % 2}", 1.0) for i in range(12)], "id string, name string, weight double")
    rows = hashed_features(samples, users, items, 512)
    local = rows.collect()
    at, value = padded([r["pairs"] for r in local])
    target = np.array([r["target"] for r in local], float)
    machine = AttentiveMachine(512, 8)
    losses = machine.fit(at, value, target, epochs=60, rate=0.05)
    assert losses[-1] < losses[0] / 2
    scored = {(r["user_id"], r["item_id"]): r["score"] for r in machine.transform(rows).collect()}
    right = np.mean([(scored[r["user_id"], r["item_id"]] > 0) == (r["target"] > 0) for r in local])
    assert right > 0.95
    with_embeddings = AttentiveMachine(512, 8, embedding=3)
    assert with_embeddings(at, value, np.zeros((len(at), 2, 3), np.float32)).shape == (len(at),)


def test_click_scores_use_all_labels(spark, monkeypatch):
    """The query's features: ids and every label at positions of their own, numbers scaled into 0..1, the operator's factors and iterations."""
    from skein.models import machine
    from skein.plans import recommender

    fitted = {}
    monkeypatch.setattr(machine, "scores", lambda model, rows: fitted.update(model=model, pairs=rows.select("pairs")) or rows.withColumn("score", F.lit(0.0)))
    recommender.md8_click_scores(spark, "/root/testdata/sf0.001")
    model, pairs = fitted["model"], [r["pairs"] for r in fitted["pairs"].collect()]
    assert model.numFeatures >= machine.DIMS and model.getFactorSize() == 8 and model.getMaxIter() == 20
    assert all(0 <= p["w"] <= 1 for row in pairs for p in row)
    where = lambda k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(model.numFeatures))).first()[0]
    held = {p["i"] for row in pairs for p in row}
    assert where("u_balance.") in held and where("i_price.") in held
    labels = spark.read.parquet("/root/testdata/sf0.001/items.parquet").select("labels.brand", "labels.type", F.explode("labels.tags").alias("tag")).where("brand is not null and type is not null and tag is not null")
    for name in ("brand", "type", "tag"):
        seen = [where(f"i_{'tags' if name == 'tag' else name}.{r[0]}") in held for r in labels.select(name).distinct().limit(5).collect()]
        assert any(seen), name


def test_blocks_fit_what_pyspark_fits(spark, monkeypatch):
    """The same weights and scores as FMClassifier from the same start, though no task and not the driver has all positions."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import Vectors

    from skein.models import machine

    dims = 128
    monkeypatch.setattr(machine, "SPAN", 32)
    rng = np.random.default_rng(4)
    side = lambda kind, n, low: {f"{kind}{k}": sorted({int(p): float(x) for p, x in zip(rng.integers(low, low + 60, 4), rng.normal(1, 0.5, 4))}.items()) for k in range(n)}
    users, items = side("u", 14, 0), side("i", 11, 60)
    rows = [(u, i, 1 if rng.random() < 0.4 else -1) for u in users for i in items]
    frames = [spark.createDataFrame([(k, [(p, x) for p, x in v]) for k, v in t.items()], "id string, pairs array<struct<i:int,w:double>>") for t in (users, items)]
    vectors = spark.createDataFrame([(u, i, float(y > 0), Vectors.sparse(dims, dict(users[u] + items[i]))) for u, i, y in rows], ["user_id", "item_id", "label", "features"])
    once = dict(factorSize=3, regParam=0.001, seed=5, solver="adamW")
    # a rate near 0 and no decay leave the first factors as they were drawn
    first = FMClassifier(maxIter=1, stepSize=1e-300, **once | {"regParam": 0.0}).fit(vectors).factors.toArray()
    monkeypatch.setattr(machine, "initial", lambda seed, owner, n, factors: np.vstack([first[owner::4], np.zeros((1, factors))]))
    theirs = FMClassifier(maxIter=12, stepSize=0.05, **once).fit(vectors)
    ours = machine.train_fm(spark.createDataFrame(rows, "user_id string, item_id string, target int"), *frames, dims, 3, 12, 0.05, 0.001, 5)
    held = {r["i"]: (r["w"], r["v"]) for r in ours.table.collect()}
    assert np.isclose(held.pop(dims)[0], theirs.intercept) and held
    for i, (w, v) in held.items():
        assert np.isclose(w, theirs.linear[i]) and np.allclose(v, theirs.factors.toArray()[i])
    want = {(r["user_id"], r["item_id"]): r["rawPrediction"][1] for r in theirs.transform(vectors).collect()}
    got = {(r["user_id"], r["item_id"]): r["score"] for r in machine.scores(ours, spark.createDataFrame([*rows, ("nobody", "none", 1)], "user_id string, item_id string, target int")).collect()}
    assert np.isclose(got.pop(("nobody", "none")), theirs.intercept)
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_search_and_stopping():
    params, score = search({"x": (0.01, 10.0), "k": [1, 2]}, lambda p: -abs(p["x"] - 1) + p["k"], 40)
    assert params["k"] == 2 and score > 1.5
    assert early_stopped(lambda e: -abs(e - 3), 50, 4) == (3, 0.0)


def test_attention_counts_when_scoring(spark, tmp_path):
    """Scores by batch are the model's, with attention over as many vectors as a row has, and no pair is cut."""
    rng = np.random.default_rng(1)
    machine = AttentiveMachine(64, 4, embedding=3, seed=2)
    for p in machine.parameters():
        p.data = rng.normal(0, 0.5, p.data.shape)
    data = [(f"u{k}", "i", [(int(x), float(v)) for x, v in zip(rng.integers(0, 64, k % 5 + 1), rng.normal(size=k % 5 + 1))], [[float(y) for y in rng.normal(size=3)] for _ in range(k % 3)] if k % 4 else None) for k in range(24)]
    df = spark.createDataFrame(data, "user_id string, item_id string, pairs array<struct<i:int,w:double>>, embeddings array<array<double>>")
    got = {r["user_id"]: r["score"] for r in machine.transform(df).collect()}
    for user, _, pairs, vectors in data:
        at, value = np.array([[i for i, _ in pairs]]), np.array([[w for _, w in pairs]], np.float32)
        alone = float(machine(at, value, np.array([vectors], np.float32) if vectors else None).data[0])
        assert np.isclose(got[user], alone, atol=1e-5)
    machine.save(str(tmp_path / "m.npz"))
    again = AttentiveMachine.load(str(tmp_path / "m.npz"))
    assert {r["user_id"]: r["score"] for r in again.transform(df).collect()} == got
    with pytest.raises(ValueError):
        machine.transform(df.drop("embeddings"))
    plain = AttentiveMachine(64, 4)
    plain.w.data = rng.normal(size=plain.w.data.shape)
    assert np.isclose({r["user_id"]: r["score"] for r in plain.transform(df).collect()}["u4"], sum(w * plain.w.data[i, 0] for i, w in data[4][2]), atol=0.02)


def test_search_with_early_stopping(spark):
    """Users like the items of their own parity; the better of two ranks is found, and a stopped fit gives its best round."""
    pairs = [(f"u{u:02d}", f"i{i:02d}") for u in range(24) for i in range(16) if u % 2 == i % 2]
    test = spark.createDataFrame([p for k, p in enumerate(pairs) if k % 7 == 0], "user_id string, item_id string")
    train = spark.createDataFrame([p for k, p in enumerate(pairs) if k % 7], "user_id string, item_id string")
    seen = []
    made = bpr(train, 4, rounds=8, epochs=2, rate=0.3, patience=2, score=lambda f: seen.append(ndcg(f, train, test)) or seen[-1])
    best = int(np.argmax(seen)) + 1
    assert len(seen) == min(8, best + 2) and ndcg(made, train, test) == max(seen)
    _, params, value = searched_bpr(train, test, {"factors": [1, 4], "rate": (0.05, 0.5)}, trials=2, rounds=2)
    assert set(params) == {"factors", "rate"} and 0 <= value <= 1
