from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.vectors import CentroidGraph, Lists, alike_pairs, balanced_centroids, nearest, usable


def brute(ids, x, k, floor):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    out = {}
    for r in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda c: (-s[r, c], ids[c]))[:k]
        out[ids[r]] = [ids[c] for c in order if s[r, c] >= floor and c != r]
    return out


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * 0.25
    return [f"v{i:05d}" for i in range(n)], (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


def test_recall_of_near_neighbours(spark):
    ids, x = clustered(3000, 24, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>")
    got = {}
    for r in nearest(df, 5, 0.9, Lists(rows=60)).collect():
        got.setdefault(r["id"], []).append(r["other"])
    want = brute(ids, x.astype(float), 5, 0.9)
    pairs = {(a, b) for a, v in want.items() for b in v}
    found = {(a, b) for a, v in got.items() for b in v}
    assert len(pairs & found) >= 0.97 * len(pairs) and len(found - pairs) <= 0.03 * len(pairs)


def test_copies_slices_and_queries(spark):
    """A third of the vectors are equal; lists are cut into slices of ten; the least ids come first."""
    rng = np.random.default_rng(2)
    ids = [f"v{i:03d}" for i in range(90)]
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "id string, vec array<float>, cid int")
    want = brute(ids, x.astype(float), 5, -1.0)
    for lists in (Lists(), Lists(slice_rows=10)):
        got = {}
        for r in nearest(df, 5, lists=lists).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["other"])
        assert got == want
    asked = spark.createDataFrame([("v000",), ("v001",)], "id string")
    assert {r["id"] for r in nearest(df, 5, queries=asked).collect()} == {"v000", "v001"}
    assert nearest(df, 5, queries=asked).count() == 10


def test_dirty_vectors_and_empty(spark, rows):
    bad = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), (" b ", [2.0, 0.0]), ("c", None), ("d", []), ("e", [1.0]), ("f", [float("nan"), 1.0]), ("g", [0.0, 0.0]), ("h", [float("inf"), 1.0]), (None, [1.0, 1.0]), ("", [1.0, 1.0]), ("i", [1.0, None])]
    df = usable(spark.createDataFrame(bad, "k string, v array<float>"), "k", "v", 2)
    assert rows(df) == [("a", [1.0, 0.0]), ("b", [2.0, 0.0])]
    assert rows(alike_pairs("s", df)) == [("s", "a", "b")]
    assert alike_pairs("s", df.limit(0)).count() == 0 and alike_pairs("s", df.where("id = 'a'")).count() == 0


def test_graph_finds_the_nearest_centroids():
    _, x = clustered(4000, 16, 3)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = balanced_centroids(x.astype(float), 200)
    found, far = CentroidGraph(c).search(x[:500], 5)
    exact = np.argsort(((x[:500, None] - c[None]) ** 2).sum(-1), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, exact)]) > 0.9 and (np.diff(far, axis=1) >= -1e-5).all()
    assert len({tuple(r) for r in balanced_centroids(np.ones((50, 4)), 8)}) == 1


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny(spark, n):
    df = spark.createDataFrame([(f"v{i}", [1.0, float(i)]) for i in range(n)], "id string, vec array<float>")
    assert nearest(df, 5).count() == n * (n - 1)


@pytest.mark.parametrize("n", [1500, 12000])
def test_recall_at_any_distance_does_not_fall_with_size(spark, n):
    """Lists of about 40 vectors, so 37 and 300 of them; every fiftieth vector asks all."""
    ids, x = clustered(n, 16, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>")
    asked = ids[::50]
    got = {(r["id"], r["other"]) for r in nearest(df, 5, lists=Lists(rows=40, probes=10, probe_ratio=2.0, probe_share=1 / 8), queries=df.select("id").where(F.col("id").isin(asked))).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for r in range(0, n, 50):
        s = u @ u[r]
        s[r] = -2
        want |= {(ids[r], ids[c]) for c in np.argsort(-s)[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_lists_follow_the_collection():
    for count, lists in ((1_000, 4), (100_000, 400), (2_500_000, 10_000), (6_000_000, 24_000), (600_000_000, 25_000)):
        assert Lists().wanted(count, Lists().sample(count)) == lists
