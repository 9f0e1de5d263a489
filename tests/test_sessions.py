from __future__ import annotations

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.operators.sessions import sessionize

GAP = 30 * 60 * 1_000_000
SCHEMA = "user_id string, timestamp timestamp_ntz, slot string, ptr int, n int, lo string"


def brute(events, gap=GAP):
    by = {}
    for user, t in events:
        if user is not None and user.strip(" ") and t is not None:
            by.setdefault(user.strip(" "), []).append(t)
    out = []
    for user, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((user, start, last, n))
                start, n = t, 0
            last = t
            n += 1
        out.append((user, start, last, n))
    return sorted(out)


def frame(spark, events):
    stamp = lambda t: None if t is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t)
    return spark.createDataFrame([(u, stamp(t), "x", 1, 2, "y") for u, t in events], SCHEMA)


def test_gap_is_inclusive(spark, rows):
    events = [("a", 0), ("a", GAP), ("a", 2 * GAP + 1), ("b", 5), (" b ", 5), ("b", 5)]
    assert rows(sessionize(frame(spark, events))) == [("a", 0, GAP, 2), ("a", 2 * GAP + 1, 2 * GAP + 1, 1), ("b", 5, 5, 3)]


def test_nulls_blanks_and_empty(spark, rows):
    assert rows(sessionize(frame(spark, [(None, 1), ("", 2), ("   ", 3), ("a", None)]))) == []
    assert rows(sessionize(frame(spark, []))) == []


def test_one_key_with_a_long_chain(spark, rows):
    """A hot key whose one session spans 300 slots, in which pointers must double many times."""
    rnd = random.Random(1)
    events = [("hot", i * (GAP - 7)) for i in range(300)] + [("hot", 10**12 + rnd.randrange(10**11)) for _ in range(300)] + [(f"u{i}", i) for i in range(20)]
    assert rows(sessionize(frame(spark, events))) == sorted(brute(events), key=lambda r: tuple((False, str(x)) for x in r))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", " a", "b", "c ", "", None]), st.one_of(st.none(), st.integers(-4 * GAP, 9 * GAP))), max_size=40))
def test_against_brute_force(spark, events):
    assert sorted(map(tuple, sessionize(frame(spark, events)).collect())) == brute(events)
