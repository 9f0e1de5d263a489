from __future__ import annotations

import numpy as np
import pandas as pd

from skein.operators import similarity


def _rows(sets: list[list[int]], weights: np.ndarray, asks: bool) -> pd.DataFrame:
    df = pd.DataFrame([(i, 0, t, weights[t]) for i, s in enumerate(sets) for t in s], columns=["id", "kind", "token", "idf"])
    own = df.groupby("id").agg(size_0=("idf", "size"), total_0=("idf", "sum"))
    return df.join(own, on="id").assign(asks=asks)


def test_long_lists_are_read_as_far_as_they_matter(monkeypatch):
    """Two tokens are in very many sets, the rest in few: the nearest are exact though few pairs are met."""
    rng = np.random.default_rng(3)
    sets = [sorted({*np.flatnonzero(rng.random(2) < (0.7, 0.4)), *rng.integers(2, 400, 5)}) for _ in range(2000)]
    sets = [list(s) for s in dict.fromkeys(map(tuple, sets))]
    held = np.zeros((len(sets), 400))
    for i, s in enumerate(sets):
        held[i, s] = 1
    weights = np.log(len(sets) / np.maximum(1, held.sum(axis=0)))
    met, ranges = [], similarity._ranges
    monkeypatch.setattr(similarity, "_ranges", lambda first, lengths: met.append(int(lengths.sum())) or ranges(first, lengths))
    got = similarity._meet(pd.concat([_rows(sets, weights, True), _rows(sets, weights, False)]), 1, 5)
    assert sum(met) < 0.2 * len(sets) ** 2
    total = held @ weights
    common, weight = held @ held.T, held * weights @ held.T
    far = 1 - weight * common / (np.sqrt(total[:, None]) * np.sqrt(total) * (common + similarity.SHRINK))
    score = np.where((common > 0) & ~np.eye(len(sets), dtype=bool), np.round(1 / (1 + far), 6), -1)
    for i, mine in got.groupby("id"):
        want = np.lexsort((np.arange(len(sets)), -score[i]))[:5]
        assert list(mine["neighbour"]) == list(want) and np.allclose(mine["score"], score[i, want])
    assert got["id"].nunique() == len(sets)


def test_ids_with_the_same_tokens_meet_once(spark, rows, monkeypatch):
    """Many ids have one of three sets; only the sets are searched, and ids of all sets have what all pairs give."""
    data = [(f"u{i:03d}", t) for i in range(240) for t in (("x", "y") if i % 3 == 0 else ("x",) if i % 3 == 1 else ("y", "z"))]
    tokens = spark.createDataFrame(data, "id string, token string")
    weights = spark.createDataFrame([("x", 0.4, 160), ("y", 0.4, 160), ("z", 1.1, 80)], "token string, idf double, freq long")
    hidden = spark.createDataFrame([(f"u{i:03d}",) for i in range(0, 240, 6)], "id string")
    pairs = similarity.token_pairs(tokens, weights)
    sent = []
    spread = similarity._spread
    monkeypatch.setattr(similarity, "_spread", lambda df, *keys: sent.append(df.count()) or spread(df, *keys))
    for hides in (None, hidden):
        got = similarity.token_neighbours(tokens, weights, 7, hides)
        assert rows(got, "id", "neighbour", "rank", "score") == rows(similarity.neighbours(pairs, 7, hides), "id", "neighbour", "rank", "score")
    assert sent == [10, 10]
