from __future__ import annotations

import datetime as dt
import random

from skein.llm.top_n import standing_scores, top_n

T = dt.datetime(2014, 1, 1)
SCHEMA = "collection string, subset string, id string, score double, is_hidden boolean, categories array<string>, timestamp timestamp_ntz, rank int, band string, have int, c int"


def frame(spark, data):
    return spark.createDataFrame([(*r[:5], None, r[5], 0, "", 0, 0) for r in data], SCHEMA)


def brute(data, n):
    last = {}
    for c, s, i, v, h, t in data:
        if i is None or not i.strip(" "):
            continue
        nan = v is not None and v != v
        order = (t is not None, t or T, v is not None, 1 if nan else 0, v if v is not None and not nan else 0, bool(h))
        key = (c, s, i.strip(" "))
        if key not in last or order > last[key][0]:
            last[key] = (order, v, h)
    groups = {}
    for (c, s, i), (_, v, h) in last.items():
        if not h and v is not None and v == v:
            groups.setdefault((c, s), []).append((-v, i))
    return {(c, s, i, -v, k + 1) for (c, s), g in groups.items() for k, (v, i) in enumerate(sorted(g)[:n])}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    value = lambda: rnd.choice([None, float("nan"), float("inf"), float("-inf"), 1.0, 2.0, rnd.random(), rnd.random() * 100])
    data = [("big", "", f"i{rnd.randrange(900)}", value(), rnd.choice([None, False, False, True]), T + dt.timedelta(rnd.randrange(5))) for _ in range(2000)]
    data += [(rnd.choice(["a", "b", None]), rnd.choice(["x", "", None]), rnd.choice([f"i{rnd.randrange(30)}", " i1 ", "", None]), value(), False, rnd.choice([None, T])) for _ in range(600)]
    got = [tuple(r) for r in top_n(standing_scores(frame(spark, data)), 10).collect()]
    assert set(got) == brute(data, 10) and len(got) == len(set(got))


def test_ties_small_groups_and_empty(spark, rows):
    data = [("a", "", f"i{k}", 1.0, False, T) for k in range(30)] + [("b", "", "z", 0.0, False, T)]
    assert rows(top_n(standing_scores(frame(spark, data)), 3), "collection", "id", "rank") == [("a", "i0", 1), ("a", "i1", 2), ("a", "i10", 3), ("b", "z", 1)]
    assert top_n(standing_scores(frame(spark, [])), 3).count() == 0
