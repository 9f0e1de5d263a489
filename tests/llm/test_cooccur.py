from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from skein.llm.cooccur import together


def brute(data, min_count, lift):
    baskets = {}
    for a, b, i in data:
        if None not in (a, b, i):
            baskets.setdefault((a, b), set()).add(i)
    n = len(baskets)
    one = Counter(i for s in baskets.values() for i in s)
    two = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    return {(x, y, c, one[x], one[y], n) for (x, y), c in two.items() if c >= min_count and c * n >= lift * one[x] * one[y]}


@pytest.mark.parametrize("whole", [2000, 6])
def test_against_brute_force(spark, whole):
    """With ``whole`` 6 most baskets are cut into item blocks."""
    rnd = random.Random(whole)
    data = []
    for k in range(300):
        group = rnd.randrange(40)
        items = {f"g{group}-{rnd.randrange(3)}" for _ in range(3)} | {f"x{rnd.randrange(200)}" for _ in range(rnd.randrange(14))} | ({"everywhere"} if rnd.random() < 0.6 else set())
        data += [(f"u{k}", "d", i) for i in items] + [(f"u{k}", "d", next(iter(items)))]
    data += [(None, "d", "a"), ("u", None, "a"), ("u", "d", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "k1 string, k2 string, item string, n int, code int")
    got = [tuple(r)[:6] for r in together(df, 5, 5.0, whole).collect()]
    assert set(got) == brute(data, 5, 5) and len(got) == len(set(got)) > 20


def test_one_large_basket_and_empty(spark):
    data = [("hot", "d", f"i{k}") for k in range(500)] + [(f"u{k}", "d", i) for k in range(3000) for i in (("a", "b") if k < 10 else (f"z{k}",))]
    got = together(spark.createDataFrame(data, "k1 string, k2 string, item string"), 5, 5.0, 50).collect()
    assert [tuple(r)[:3] for r in got] == [("a", "b", 10)]
    assert together(spark.createDataFrame([], "k1 string, k2 string, item string")).count() == 0
