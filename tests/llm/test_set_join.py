from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from skein.llm import set_join
from skein.llm.set_join import Segments, item_classes, similar_items, similar_sets

ITEMS = "item_id string, categories array<string>, labels struct<tags: array<string>>, rep string, n int, terms string"


def frame(spark, data):
    return spark.createDataFrame([(i, c, None if t is None else (t,), "r", 1, "x") for i, c, t in data], ITEMS)


def sets_of(data):
    out = {}
    for i, c, t in data:
        if i is not None and i.strip(" "):
            out.setdefault(i.strip(" "), set()).update(x.strip(" ").lower() for x in (c or []) + (t or []) if x is not None and x.strip(" "))
    return {i: s for i, s in out.items() if len(s) >= 4}


def brute(data):
    s = sets_of(data)
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if 5 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b])}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    common, rare = ["new", "home", "sale"], [f"w{k}" for k in range(60 if seed == 2 else 300)]
    data = []
    for k in range(250):
        base = [w for w in common if rnd.random() < 0.4] + rnd.sample(rare, rnd.randint(1, 12))
        data.append((f"i{k:04d}", base[:3], base[3:]))
        for _ in range(rnd.randrange(3)):
            other = [w for w in base if rnd.random() > 0.15] + rnd.sample(rare, rnd.randrange(3))
            rnd.shuffle(other)
            data.append((f"j{k:04d}{rnd.randrange(99):02d}", [" " + w.upper() for w in other], other[:1]))
    got = [tuple(r) for r in similar_items(frame(spark, data)).collect()]
    assert set(got) == brute(data) and len(got) == len(set(got))


def test_only_frequent_terms(spark):
    """Sets made of a few terms that everyone has: every signature is hot, and no link may be lost."""
    words = [f"t{k}" for k in range(9)]
    data = [(f"i{k:03d}", list(c), None) for k, c in enumerate(itertools.chain(*(itertools.combinations(words, n) for n in (4, 5, 6, 7))))]
    assert {tuple(r) for r in similar_items(frame(spark, data)).collect()} == brute(data)


def test_dirty_rows_copies_and_empty(spark, rows):
    data = [("a", ["x", "X ", None, ""], ["y", "z", "w"]), (" a", None, ["w"]), ("b", ["x", "y"], ["z", "w"]), ("c", ["w", "x", "y", "z", "v"], None), ("d", None, None), (None, ["x", "y", "z", "w"], None), ("e", ["x", "y", "z"], []), ("", ["x", "y", "z", "w"], None)]
    assert rows(similar_items(frame(spark, data))) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(item_classes(frame(spark, data))) == [("a", "a", 2, 2), ("b", "a", 2, 2), ("c", "c", 1, 2)]
    assert similar_items(frame(spark, [])).count() == 0
    many = [(f"k{k:03d}", ["p", "q", "r", "s"], None) for k in range(60)]
    assert similar_items(frame(spark, many)).count() == 60 * 59 // 2
    classes, pairs = similar_sets(spark.createDataFrame([(f"k{k}", ["p", "q", "r", "s"]) for k in range(60)], "id string, terms array<string>"))
    assert [r["n"] for r in classes.collect()] == [60] and pairs.count() == 0


def test_bound_is_the_largest_difference():
    s = Segments(3, 5, 4, 10, {}, set())
    for a in range(4, 30):
        for b in range(a, s.longest(a) + 1):
            possible = [a + b - 2 * c for c in range(a + 1) if 5 * c >= 3 * (a + b - c)]
            assert s.bound(a, b) == max(possible)


def test_long_sets_beside_short_ones(spark):
    """Sets of about 300 tokens, some differing by just as much as allowed, in pieces of classes of 7 members."""
    rnd = random.Random(9)
    universe = [f"u{k}" for k in range(4000)]
    data = []
    for k in range(12):
        base = rnd.sample(universe, rnd.randint(4, 330))
        data.append((f"i{k:02d}", base, None))
        rest = [w for w in universe if w not in set(base)]
        for share in (0.1, 0.24, 0.25, 0.26, 0.4):
            gone = int(len(base) * share)
            data.append((f"i{k:02d}x{share}", base[gone:] + rnd.sample(rest, gone), None))
            data.append((f"i{k:02d}y{share}", base[int(gone * 1.6) :], None))
    data += [(f"c{k:02d}", data[0][1], None) for k in range(20)]
    want = brute(data)
    assert len(want) > 300 and {tuple(r) for r in similar_items(frame(spark, data)).collect()} == want


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(set_join, "PIECE_ROWS", 3)
    data = [(f"a{k}", list("pqrs"), None) for k in range(11)] + [(f"b{k}", list("pqrst"), None) for k in range(8)]
    got = [tuple(r) for r in similar_items(frame(spark, data)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_nothing_that_follows_the_rows_is_broadcast(spark, monkeypatch):
    """Under the default threshold, where a table of some MB of classes had all its signatures broadcast from the driver."""
    plans = []
    cut = set_join.Scratch.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(set_join.Scratch, "cut", lambda self, df: plan(df) or cut(self, df))
    assert int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) >= 10 << 20
    data = [(f"a{k}", list("pqrs"), None) for k in range(5)] + [(f"b{k}", list("pqrst"), None) for k in range(3)]
    plan(similar_items(frame(spark, data)))
    plan(item_classes(frame(spark, data)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 12 and not any("Broadcast" in p for p in plans)


def test_signatures_grow_with_the_size():
    rng = np.random.default_rng(0)
    s = Segments(3, 5, 4, 10_000, {}, set())
    for size in (20, 60, 200, 400):
        tokens = np.stack([rng.choice(2**40, size, replace=False) for _ in range(3)]).astype(np.int64)
        made = sum(len(r) for r, _ in s.asked(tokens)) + sum(len(r) for r, _ in s.given(tokens))
        assert made / 3 < 12 * size, (size, made / 3)
        low, high = set_join._sketch(np.sort(tokens, axis=1))
        for i, j in itertools.combinations(range(3), 2):
            apart = bin(int(low[i] ^ low[j]) & (2**64 - 1)).count("1") + bin(int(high[i] ^ high[j]) & (2**64 - 1)).count("1")
            assert apart <= len(set(tokens[i]) ^ set(tokens[j]))
