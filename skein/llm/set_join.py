"""All similar pairs of sets by pigeonhole partitioning of the token universe (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import clean_id
from skein.lineage import Scratch

RARE_SHARE = 1 / 5000  # tokens of less than this share of the sets are taken as equally rare
LIST_ROWS = 20_000  # signatures expected in more sets are salted
PIECE_ROWS = 2_000  # members of a larger class are cut into pieces of about so many
FULL, SHORT = 1, 2  # kinds of signature: a whole segment, a segment without one token
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Segments:
    """Signatures of sets for one threshold ``num / den`` on the Jaccard similarity.

    A similar pair of sizes a <= b differs in at most ``(den - num) (a + b) / (den + num)`` tokens, of the parity of
    b - a. Sizes are grouped so that a group's largest, its ``top``, is little more than its least, small sizes each
    alone; for sets of a group the universe is cut by hash into ``segments(top)`` segments. If values 1 (the segment
    must be equal) and 2 (it may differ by one token, found by one-deletion signatures) are given to segments so that
    they exceed the bound of every size of the group, a similar pair agrees in one of them. The larger set chooses the
    values for each group of smaller sizes, as cheaply as token frequencies promise; the smaller one gives all its
    signatures. A set has signatures in proportion to its size, as it meets a fixed number of groups.
    """

    def __init__(self, num: int, den: int, least: int, sets: int, frequent: dict[int, int], empties: set[int]):
        self.num, self.den, self.least, self.sets, self.empties = num, den, least, max(sets, 1), empties
        self.rare = self.weight(RARE_SHARE / 4)
        known = np.array(sorted(frequent), np.int64)
        self.known, self.known_w = known, np.array([self.weight(frequent[int(t)] / self.sets) for t in known], np.int64)

    @staticmethod
    def weight(share: float) -> int:
        """Minus the binary logarithm in sixteenths, a whole number, so that sums agree on both sides."""
        return max(0, round(-16 * math.log2(max(share, 1e-12))))

    def bound(self, a: int, b: int) -> int:
        h = (self.den - self.num) * (a + b) // (self.den + self.num)
        return h - (h - (b - a)) % 2

    def longest(self, a: int) -> int:
        return a * self.den // self.num

    @staticmethod
    def top(a: int) -> int:
        """The largest size of the group of a: sizes up to 12 alone, beyond them an eighth of the power of 2 below."""
        step = max(1, (1 << (a.bit_length() - 1)) // 8) if a > 12 else 1
        return -(-a // step) * step

    def segments(self, a: int) -> int:
        return 2 * (max(self.bound(a, b) for b in range(a, self.longest(a) + 1)) + 1)

    def _parts(self, tokens: np.ndarray, a: int):
        """Of sets (rows) of one size, for the group with top a: the segment of each token, and by segment the number, hash and weight of its tokens."""
        m = self.segments(a)
        h = _mix(tokens.view(U) + U(0x9E3779B97F4A7C15))
        seg = (_mix(h + U(a)) % U(m)).astype(np.int64)
        w = np.full(tokens.shape, self.rare, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
            w = np.where(self.known[at] == tokens, self.known_w[at], w)
        k, content, weight = np.zeros((len(tokens), m), np.int64), np.zeros((len(tokens), m), U), np.zeros((len(tokens), m), np.int64)
        rows = np.arange(len(tokens))
        with np.errstate(over="ignore"):
            for c in range(tokens.shape[1]):
                np.add.at(k, (rows, seg[:, c]), 1)
                content[rows, seg[:, c]] += h[:, c]
                weight[rows, seg[:, c]] += w[:, c]
        return seg, h, w, k, content, weight

    def _rows_of(self, k: np.ndarray, weight: np.ndarray, a: int, kind: int) -> np.ndarray:
        """Sets of the group with top a expected to have a signature of k tokens of this weight."""
        m = self.segments(a)
        stay = 1 - 1 / m
        rest = stay ** np.maximum(a - k, 0) if kind == FULL else np.maximum(a - k, 0) / m * stay ** np.maximum(a - k - 1, 0)
        return self.sets * np.exp2(-weight / 16) * rest

    def _signature(self, content: np.ndarray, i: np.ndarray, a: int, kind: int, salt: np.ndarray | int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(content + _mix(i.astype(U) * U(4099) + U(a * 8 + kind)) + np.asarray(salt).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)

    def _salts(self, k: np.ndarray, weight: np.ndarray, a: int, kind: int) -> np.ndarray:
        return np.minimum(256, np.ceil(np.maximum(1, self._rows_of(k, weight, a, kind) / LIST_ROWS))).astype(np.int64)

    def given(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, signature) of the sets as the smaller side of a pair."""
        size = tokens.shape[1]
        a = self.top(size)
        seg, h, w, k, content, weight = self._parts(tokens, a)
        spread = _mix(h.sum(axis=1, dtype=U))
        for i in range(k.shape[1]):
            r = np.flatnonzero((k[:, i] > 0) | (a in self.empties))
            salts = self._salts(k[r, i], weight[r, i], a, FULL)
            yield r, self._signature(content[r, i], np.full(len(r), i), a, FULL, spread[r] % salts.astype(U))
        for c in range(size):
            i = seg[:, c]
            r = np.flatnonzero(k[np.arange(len(k)), i] > 1)
            i = i[r]
            with np.errstate(over="ignore"):
                short = content[r, i] - h[r, c]
            salts = self._salts(k[r, i] - 1, weight[r, i] - w[r, c], a, SHORT)
            yield r, self._signature(short, i, a, SHORT, spread[r] % salts.astype(U))

    def groups(self, b: int) -> dict[int, int]:
        """Tops of the groups that smaller partners of sets of size b may be in, each with what values must add up to."""
        need: dict[int, int] = {}
        for a in range(max(self.least, -(-b * self.num // self.den)), b + 1):
            need[self.top(a)] = max(need.get(self.top(a), 0), self.bound(a, b) + 1)
        return need

    def starved(self, tokens: np.ndarray, a: int, need: int) -> np.ndarray:
        """Sets whose own tokens can't carry the values needed for partners of a group; they use empty segments too."""
        k = self._parts(tokens, a)[3]
        return np.minimum(k, 2).sum(axis=1) < need

    def at_once(self, size: int) -> int:
        """Sets of one size that are worked on together, so that the tables of choices stay some ten MB."""
        top = self.top(size)
        return max(1, 20_000_000 // (self.segments(top) * (self.bound(size, size) + 2)))

    def asked(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, signature) of the sets as the larger side of a pair."""
        b = tokens.shape[1]
        for a, need in self.groups(b).items():
            seg, h, w, k, content, weight = self._parts(tokens, a)
            n, m = k.shape
            starved = np.minimum(k, 2).sum(axis=1) < need
            one = 1 + self._rows_of(k, weight, a, FULL)
            one[(k == 0) & ~starved[:, None]] = np.inf
            two = one + 1 + self._rows_of(k, weight, a, SHORT)
            for c in range(b):
                i = seg[:, c]
                two[np.arange(n), i] += 1 + self._rows_of(k[np.arange(n), i] - 1, weight[np.arange(n), i] - w[:, c], a, FULL)
            two[k < 2] = np.inf
            best = np.full((n, need + 1), np.inf)
            best[:, 0] = 0
            choice = np.zeros((m, n, need + 1), np.int8)
            to = np.arange(need + 1)
            for i in range(m):
                options = np.stack([best, best[:, np.maximum(to - 1, 0)] + one[:, i, None], best[:, np.maximum(to - 2, 0)] + two[:, i, None]])
                options[1:, :, 0] = np.inf
                choice[i] = options.argmin(axis=0)
                best = options.min(axis=0)
            left = np.full(n, need)
            value = np.zeros((n, m), np.int8)
            for i in range(m - 1, -1, -1):
                value[:, i] = choice[i, np.arange(n), left]
                left = np.maximum(0, left - value[:, i])
            for i in range(m):
                r = np.flatnonzero(value[:, i] > 0)
                yield from self._spread(r, content[r, i], k[r, i], weight[r, i], np.full(len(r), i), a, FULL)
                r = np.flatnonzero(value[:, i] > 1)
                yield from self._spread(r, content[r, i], k[r, i], weight[r, i], np.full(len(r), i), a, SHORT)
            for c in range(b):
                i = seg[:, c]
                r = np.flatnonzero(value[np.arange(n), i] > 1)
                i = i[r]
                with np.errstate(over="ignore"):
                    yield from self._spread(r, content[r, i] - h[r, c], k[r, i] - 1, weight[r, i] - w[r, c], i, a, FULL)

    def _spread(self, r, content, k, weight, i, a, kind):
        salts = self._salts(k, weight, a, kind)
        for s in range(int(salts.max(initial=0))):
            some = salts > s
            yield r[some], self._signature(content[some], i[some], a, kind, s)


def _by_size(batch: pa.RecordBatch, at_once) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    column = batch.column(1)
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        same, step = np.flatnonzero(sizes == size), at_once(int(size))
        for start in range(0, len(same), step):
            rows = same[start : start + step]
            yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def _sketch(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parities of the tokens of each set: two sets differ in at least as many tokens as their sketches in bits."""
    bit = (_mix(tokens.view(U) ^ U(0xC2B2AE3D27D4EB4F)) % U(128)).astype(np.int64)
    word = np.left_shift(U(1), (bit % 64).astype(U))
    low, high = np.where(bit < 64, word, U(0)), np.where(bit < 64, U(0), word)
    return np.bitwise_xor.reduce(low, axis=1).view(np.int64), np.bitwise_xor.reduce(high, axis=1).view(np.int64)


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast: signatures, pieces and pairs are planned as small as the compressed table they come from."""
    return df.hint("merge")


def similar_sets(sets: DataFrame, num: int = 3, den: int = 5, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the pairs of similar classes: ``(rep, terms, n)`` and ``(rep_a, rep_b)``, rep_a < rep_b.

    ``sets`` has ``id, terms`` (distinct strings, sorted). Sets of fewer than ``least`` terms take no part; two classes
    are similar if the common terms are at least ``num / den`` of the distinct terms of both. ``rep`` is the least id
    of a class. No link is lost: signatures only choose candidates by the pigeonhole bound, parity sketches only drop
    candidates that differ in too many tokens, and each distinct candidate is verified on the terms themselves.
    Signatures shared by very many sets are salted on both sides. Nothing that follows the rows is broadcast, whatever
    the session's threshold. An empty table gives no rows.
    """
    spark = sets.sparkSession
    scratch = Scratch(spark, "sets")
    classes = sets.where(F.size("terms") >= least).groupBy("terms").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.cut(classes.select("rep", "terms", "n").withColumn("cid", F.monotonically_increasing_id()))
    hashed = classes.select("cid", F.transform("terms", lambda t: F.xxhash64(t)).alias("tokens"))
    count = classes.count()
    # the shares of these tokens add up to the mean size of a set, so there are at most mean size / RARE_SHARE of them
    counts = hashed.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, count * RARE_SHARE))
    frequent = {r["t"]: r["n"] for r in counts.collect()}
    plain = Segments(num, den, least, count, frequent, set())

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for _, tokens in _by_size(batch, plain.at_once):
                found |= {a for a, n in plain.groups(tokens.shape[1]).items() if a not in found and plain.starved(tokens, a, n).any()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["a"])

    empties = {r["a"] for r in hashed.mapInArrow(need, "a int").distinct().collect()}  # tops of groups of sizes
    segments = Segments(num, den, least, count, frequent, empties)

    def signatures(method: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2000):
                    part = batch.slice(start, 2000)
                    ids = part.column(0).to_numpy()
                    for rows, tokens in _by_size(part, segments.at_once):
                        pairs = [p for p in getattr(segments, method)(tokens) if len(p[0])]
                        if pairs:
                            r, s = (np.concatenate(x) for x in zip(*pairs))
                            low, high = _sketch(tokens)
                            size = np.full(len(r), tokens.shape[1], np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, ids[rows][r], size, low[r], high[r])], ["signature", "cid", "size", "low", "high"])

        return hashed.mapInArrow(run, "signature bigint, cid bigint, size int, low bigint, high bigint")

    small, large = signatures("given").alias("s"), signatures("asked").alias("l")
    a, b = F.col("s.size"), F.col("l.size")
    fits = (a <= b) & ((a < b) | (F.col("s.cid") < F.col("l.cid")))
    apart = F.bit_count(F.col("s.low").bitwiseXOR(F.col("l.low"))) + F.bit_count(F.col("s.high").bitwiseXOR(F.col("l.high")))
    near = (a * den >= b * num) & (apart * (den + num) <= (a + b) * (den - num))
    pairs = small.join(_merged(large), (F.col("s.signature") == F.col("l.signature")) & fits & near)
    pairs = pairs.select(F.col("s.cid").alias("cid_a"), F.col("l.cid").alias("cid_b")).distinct()
    side = lambda x: classes.select(F.col("cid").alias(f"cid_{x}"), F.col("rep").alias(f"r{x}"), F.col("terms").alias(f"terms_{x}"))
    exact = F.size(F.array_intersect("terms_a", "terms_b")) * (num + den) >= (F.size("terms_a") + F.size("terms_b")) * num
    found = pairs.join(_merged(side("a")), "cid_a").join(_merged(side("b")), "cid_b").where(exact)
    return classes.select("rep", "terms", "n"), scratch.cut(found.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b")))


def item_terms(items: DataFrame) -> DataFrame:
    """``id, terms``: the distinct values of ``categories`` and ``labels.tags`` of each trimmed item id, trimmed, in lower case, without nulls and blanks, sorted."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("categories", none), F.coalesce("labels.tags", none))
    clean = F.filter(F.transform(both, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (F.trim(t) != ""))
    rows = items.select(clean_id("item_id").alias("id"), F.array_sort(F.array_distinct(F.transform(clean, lambda t: F.trim(t)))).alias("terms")).where("id is not null")
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))


def similar_items(items: DataFrame) -> DataFrame:
    """``item_a, item_b`` of all similar pairs of different item ids, copies included.

    Members of large classes come in pieces, so that neither a class's pairs within itself nor those with another one
    are a single task's.
    """
    sets = item_terms(items)
    classes, pairs = similar_sets(sets)
    members = sets.join(_merged(classes.select("terms", "rep", "n")), "terms").select("id", "rep", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"))
    members = members.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    pieces = classes.select("rep", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"))
    of = lambda x: members.select(F.col("rep").alias(f"rep_{x}"), "piece", F.col("id").alias(f"id_{x}"))
    for x in "ab":
        kept = [c for c in pairs.columns if c != f"rep_{x}"]
        split = pairs.join(_merged(pieces.withColumnRenamed("rep", f"rep_{x}")), f"rep_{x}").select(f"rep_{x}", *kept, every)
        pairs = split.join(_merged(of(x)), [f"rep_{x}", "piece"]).drop("piece")
    across = pairs.select(F.least("id_a", "id_b").alias("item_a"), F.greatest("id_a", "id_b").alias("item_b"))
    copied = members.join(_merged(classes.where("n > 1").select("rep")), "rep")
    one, two = copied.select("rep", "piece", F.col("id").alias("item_a")), copied.select("rep", every, F.col("id").alias("item_b"))
    return across.unionByName(one.join(_merged(two), ["rep", "piece"]).where("item_a < item_b").select("item_a", "item_b"))


def item_classes(items: DataFrame) -> DataFrame:
    """One row per item with enough terms: ``item_id, class_id, class_size, links``; ``links`` counts the similar other items."""
    sets = item_terms(items)
    classes, pairs = similar_sets(sets)
    sizes = classes.select("rep", "n")
    ends = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    linked = ends.join(_merged(sizes.select(F.col("rep").alias("other"), F.col("n").alias("m"))), "other").groupBy("rep").agg(F.sum("m").alias("m"))
    told = classes.join(_merged(linked), "rep", "left").select("terms", F.col("rep").alias("class_id"), F.col("n").alias("class_size"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return sets.join(_merged(told), "terms").select(F.col("id").alias("item_id"), "class_id", "class_size", "links")
