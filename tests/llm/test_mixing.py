from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from skein.llm.mixing import Mixture, fill, pfair_slots, refill

DOCS = "doc_id long, text string, source string, n_tokens long, slot int, wanted double"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_share double"


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, 0, 0, 0.0) for i, t, s in data], DOCS)


def test_fill():
    assert fill({"a": 1, "b": 1}, {"a": 100, "b": 100}, 10) == {"a": 5, "b": 5}
    assert fill({"a": 1, "b": 1}, {"a": 2, "b": 100}, 10) == {"a": 2, "b": 8}
    assert fill({"a": 1, "b": 3}, {"a": 1, "b": 2}, 10) == {"a": 1, "b": 2}
    assert fill({"a": 0, "b": 1}, {"a": 9, "b": 9}, 4) == {"a": 0, "b": 4} and fill({}, {}, 5) == {}


def furthest(rows):
    """The furthest that a source of ``(source, tokens)``, in order, ever is from its share of the tokens so far."""
    totals = Counter()
    for s, n in rows:
        totals[s] += n
    whole, seen, out, worst = sum(totals.values()), Counter(), 0, 0.0
    for s, n in rows:
        seen[s] += n
        out += n
        worst = max([worst, *(abs(seen[x] - out * t / whole) for x, t in totals.items())])
    return worst


@pytest.mark.parametrize("counts", [{"a": 500, "b": 300, "c": 199, "d": 1}, {"a": 1000}, {"a": 333, "b": 333, "c": 334}, {f"s{i}": 2**i for i in range(10)}])
@pytest.mark.parametrize("longest", [1, 7, 400])
def test_pfair_deviates_by_a_block_at_most(counts, longest):
    rng = random.Random(longest)
    blocks = {(s, 3 * j): rng.randint(1, longest) for s, n in counts.items() for j in range(n)}
    slots = pfair_slots(blocks)
    assert sorted(slots.values()) == list(range(len(blocks))) and slots.keys() == blocks.keys()
    order = sorted(slots, key=slots.get)
    assert furthest([(k[0], blocks[k]) for k in order]) <= max(blocks.values()) + 1e-6
    for s in counts:
        own = [j for x, j in order if x == s]
        assert own == sorted(own)


def test_refill():
    assert refill(10, {4: 1, 3: 1, 20: 5}) == {4: 1, 3: 1} and refill(10, {4: 9}) == {4: 2} and refill(11.9, {4: 9}) == {4: 3}
    assert refill(7, {10: 1}) == {10: 1} and refill(4, {10: 1}) == {} and refill(5, {}) == {}


def test_a_text_of_two_sources_belongs_to_each_mix_that_names_one(spark):
    data = [(i, f"shared text of number {i}", "a") for i in range(50)] + [(100 + i, f"shared text of number {i}", "b") for i in range(50)] + [(999, "one more here", "b")]
    targets = [("m1", "a", 1.0, 1, 0.4), ("m1", "b", 1.0, 1, 0.4), ("m2", "b", 1.0, 1, 0.4), ("m3", "b", 1.0, 1, 0.4), ("m3", "a", 0.0, 1, 0.4)]
    mix = Mixture(docs(spark, data), spark.createDataFrame(targets, TARGETS))
    texts = {(r["mix_name"], r["source"]): r["texts"] for r in mix.stocks().collect()}
    assert texts == {("m1", "a"): 50, ("m1", "b"): 1, ("m2", "b"): 51, ("m3", "b"): 51, ("m3", "a"): 0}
    for r in mix.shares().where("mix_name <> 'm1' and source = 'b'").collect():
        assert r["docs"] > 30 and abs(r["tokens"] - r["wanted_tokens"]) <= 5


def test_long_texts_leave_no_gap_and_blocks_keep_their_bound(spark):
    rng = random.Random(4)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(400 if rng.random() < 0.02 else rng.randint(2, 30)))
    data = [(i, words(), rng.choice("aaaaaabbc")) for i in range(1500)]
    targets = [("m", "a", 5.0, 1, 0.5), ("m", "b", 4.0, 2, 0.5), ("m", "c", 1.0, 1, 0.5)]
    mix = Mixture(docs(spark, data), spark.createDataFrame(targets, TARGETS))
    for r in mix.shares().collect():
        assert abs(r["tokens"] - r["wanted_tokens"]) <= 10
    rows = [(r["source"], r["n_tokens"]) for r in mix.selection.orderBy("slot", "start").collect()]
    assert furthest(rows) <= mix.plan.first()["block"]
    assert all(n == 1 for (d, u), n in Counter((r["doc_id"], r["use_no"]) for r in mix.selection.collect()).items())


def test_mix(spark):
    data = [(i, f"text number {i} of the large source", "Large ") for i in range(400)] + [(1000 + i, f"small {i}", "small-src") for i in range(20)]
    data += [(2000 + i, "the same words", "small_src") for i in range(5)] + [(3000, None, "large"), (3001, "", "large"), (3002, "x", None), (3003, "y", "nobody")]
    targets = [("m", "large", 3.0, 1, 0.3), ("m", "small_src", 1.0, 2, 0.3), ("m", "absent", 1.0, 9, 0.3), ("m", "large", 0.0, 1, 0.3), ("z", "small_src", 1.0, 3, 5.0), (None, "large", 1.0, 1, 1.0)]
    mix = Mixture(docs(spark, data), spark.createDataFrame(targets, TARGETS), blocks=50)
    rows = [r.asDict() for r in mix.selection.collect()]
    plan = {(r["mix_name"], r["source"]): r for r in mix.plan.collect()}
    got, uses = defaultdict(int), Counter()
    for r in rows:
        got[r["mix_name"], r["source"]] += r["n_tokens"]
        uses[r["mix_name"], r["doc_id"]] += 1
    for key, n in got.items():
        assert abs(n - plan[key]["wanted"]) <= 10
    assert max(v for (m, d), v in uses.items() if m == "m" and d < 1000) == 1 and max(v for (m, d), v in uses.items() if m == "m") == 2
    assert max(v for (m, d), v in uses.items() if m == "z") == 3
    assert len({d for _, d in uses if 2000 <= d < 2005}) == 1 and not {3000, 3001, 3002, 3003} & {d for _, d in uses}
    assert math.isclose(got["z", "small_src"], 3 * plan["z", "small_src"]["supply"])
    total = sum(n for (m, _), n in got.items() if m == "m")
    ordered = sorted((r for r in rows if r["mix_name"] == "m"), key=lambda r: (r["slot"], r["start"]))
    assert furthest([(r["source"], r["n_tokens"]) for r in ordered]) <= plan["m", "large"]["block"]
    shares = {(r["mix_name"], r["source"]): r for r in mix.shares().collect()}
    assert shares["m", "absent"]["tokens"] == 0 and math.isclose(sum(r["share"] for (m, _), r in shares.items() if m == "m"), 1) and shares["m", "large"]["tokens"] == got["m", "large"] and total


def test_empty(spark):
    none = Mixture(docs(spark, []), spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], TARGETS))
    assert none.selection.count() == 0 and none.shares().first()["tokens"] == 0
    assert Mixture(docs(spark, [(1, "a", "a")]), spark.createDataFrame([], TARGETS)).selection.count() == 0
    odd = Mixture(docs(spark, [(1, "a b c", "a")]), spark.createDataFrame([("m", "a", float("nan"), 1, 1.0), ("m", "b", -1.0, 1, 1.0), ("m", None, 1.0, None, None)], TARGETS))
    assert odd.selection.count() == 0
