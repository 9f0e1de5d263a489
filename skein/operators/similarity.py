"""Neighbour lists of items and users by tags, co-interaction, both, or embeddings (RC3 to RC11, DI2, JN8, AN2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.lineage import Scratch

SHRINK = 100
VECTOR_ROWS = 20_000  # vectors of a block
BLOCK_ROWS = 1_000_000  # token rows of a block of ids
CELLS = 2_000_000  # rows of posting lists that are worked on at once
LONG_LIST = 200  # a block's posting lists of more ids are read only as far as they may matter
HEAD = 100  # so many ids of a long list are read before it is known how far it matters
LONG_CELLS = 50_000_000  # at most so many bytes tell which ids are in long lists
POSTING = 2000  # a token's posting list is joined in pieces of about so many ids


def idf_distance(common_idf: Column, common: Column, idf_a: Column, idf_b: Column, size_a: Column, size_b: Column) -> Column:
    """0 for equal sets, 1 for disjoint ones, else ``1 - common_idf * c / (sqrt(idf_a) * sqrt(idf_b) * (c + 100))`` (DI2)."""
    shrunk = 1 - common_idf * common / (F.sqrt(idf_a) * F.sqrt(idf_b) * (common + SHRINK))
    return F.when((common == size_a) & (common == size_b), 0.0).when(common > 0, shrunk).otherwise(1.0)


def token_pairs(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """``a, b, distance`` of all ordered pairs that share a token; ``tokens`` has distinct ``id, token``, ``weights`` ``token, idf, freq``.

    An inverted-index equi-join: pairs that share nothing are never made. A long posting list is cut by a hash of its
    left ids, and its right ids are repeated for each piece, so one token is many tasks' work; counts of a pair are
    combined before they are shuffled.
    """
    held = tokens.join(weights.select("token", "idf"), "token")
    sizes = held.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum("idf").alias("idf"))
    lengths = tokens.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(POSTING)).cast("int").alias("pieces"))
    placed = held.join(lengths, "token")
    left = placed.select("token", F.col("id").alias("a"), "idf", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    right = placed.select("token", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    common = left.join(right, ["token", "piece"]).where("a <> b").groupBy("a", "b").agg(F.sum("idf").alias("common_idf"), F.count(F.lit(1)).alias("common"))
    side = lambda s: sizes.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("idf").alias(f"idf_{s}"))
    pairs = common.join(side("a"), "a").join(side("b"), "b")
    return pairs.select("a", "b", idf_distance(*[F.col(c) for c in ("common_idf", "common", "idf_a", "idf_b", "size_a", "size_b")]).alias("distance"))


def token_neighbours(tokens: DataFrame, weights: DataFrame, n: int, hidden: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """What ``neighbours(token_pairs(tokens, weights), n, hidden)`` gives, without a table of pairs (RC4, RC5, RC8 to RC11)."""
    return shared_token_neighbours([(tokens, weights)], n, hidden, block_rows)


def shared_token_neighbours(kinds: list[tuple[DataFrame, DataFrame]], n: int, hidden: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """``id, neighbour, score, rank``: the ``n`` nearest by the mean distance over ``kinds`` of tokens (RC4 to RC6, RC10).

    Each kind is (``id, token`` distinct, ``token, idf``). Only ids that share a token of some kind are near. Of a
    kind, ids that share nothing are 1 apart, and 0 if neither has any token of it. Ids with the same tokens of all
    kinds are 0 apart, so they are no neighbours, and have the same ones: they are one class, which is searched for
    once and stands for its ``n`` first ids. Classes are hashed into blocks of at most about ``block_rows`` token rows,
    and of smaller tables into enough for all cores. A token row goes to those blocks that have its token, with the size
    and weight of its class, so rare tokens are sent to few blocks however many there are; only tokens of very many
    classes go to all. Two blocks meet in one task, and only the ``n`` best of a block go on. There the short posting
    lists are read whole; what shares only tokens of long ones is read as far as it may still be among the ``n`` best
    (see ``_meet``). The tokens of one id must fit a task.
    """
    held = None
    for kind, (tokens, weights) in enumerate(kinds):
        part = tokens.join(weights.select("token", "idf"), "token").select("id", F.lit(kind).alias("kind"), F.xxhash64("token", F.lit(kind)).alias("token"), "idf")
        held = part if held is None else held.unionByName(part)
    scratch = Scratch(held.sparkSession, "tokens")
    held = scratch.cut(held)
    of = lambda k: F.col("kind") == k
    number = len(kinds)
    own = [x for k in range(number) for x in (F.count_if(of(k)).alias(f"size_{k}"), F.coalesce(F.sum(F.when(of(k), F.col("idf"))), F.lit(0.0)).alias(f"total_{k}"))]
    key = ["_x", "_y", *(f"size_{k}" for k in range(number))]  # 128 bits and the sizes tell sets of tokens apart
    sets = scratch.cut(held.groupBy("id").agg(F.bit_xor(F.xxhash64("kind", "token")).alias("_x"), F.bit_xor(F.xxhash64("token", F.lit("y"), "kind")).alias("_y"), *own))
    hides = sets.withColumn("_h", F.lit(False)) if hidden is None else sets.join(hidden.select("id").distinct().withColumn("_h", F.lit(True)), "id", "left").withColumn("_h", F.coalesce("_h", F.lit(False)))
    # numbers in order of the first ids, by which ties are broken
    classes = scratch.cut(hides.groupBy(*key).agg(F.min("id").alias("id"), F.min(F.when(~F.col("_h"), F.col("id"))).alias("first"), *[F.min_by(f"total_{k}", "id").alias(f"total_{k}") for k in range(number)]).orderBy(F.coalesce("first", "id")).withColumn("no", F.monotonically_increasing_id()))
    held = held.join(classes.drop("_x", "_y"), "id").drop("id").withColumnRenamed("no", "id").withColumn("shown", F.col("first").isNotNull()).drop("first")
    rows = held.count()
    blocks = max(1, -(-rows // (block_rows or BLOCK_ROWS)), 0 if block_rows else min(16, rows // 4_000))
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    shown = held.where("shown")
    columns = ["id", "kind", "token", "idf", *(f"{x}_{k}" for k in range(number) for x in ("size", "total"))]

    def sent(rows: DataFrame, others: DataFrame, mine: str, theirs: str, asks: bool) -> DataFrame:
        if blocks == 1:
            return rows.select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(asks).alias("asks"))
        where = others.groupBy("kind", "token").agg(F.collect_set("block").alias("_to"))  # at most the blocks
        met = rows.join(where, ["kind", "token"]).select(*columns, F.col("block").alias(mine), F.explode("_to").alias(theirs), F.lit(asks).alias("asks"))
        return met.select(*columns, "i", "j", "asks")

    left, right = sent(held, shown, "i", "j", True), sent(shown, held, "j", "i", False)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return _meet(group, number, n)

    found = _spread(left.unionByName(right), blocks * blocks, "i", "j").groupBy("i", "j").applyInPandas(meet, "id bigint, neighbour bigint, score double")
    ranked = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n).drop("rank")
    # classes in place of ids from here: those that a class is near to, then their ids, then the ids of the class
    listed = hides.where("not _h").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("_r") <= n)
    listed = listed.join(classes.select(*key, "no"), key).select(F.col("no").alias("neighbour"), F.col("id").alias("_n"))
    best = best.join(listed, "neighbour").select("id", F.col("_n").alias("neighbour"), "score").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)
    members = sets.join(classes.select(*key, F.col("no").alias("_rep")), key).select("_rep", "id")
    return members.join(best.withColumnRenamed("id", "_rep"), "_rep").select("id", "neighbour", "score", "rank")


class _Side:
    """One block's ids, their sizes and weights of each kind, and their token rows in order of id; tokens as ``codes`` number them."""

    def __init__(self, part: pd.DataFrame, kinds: int, codes: np.ndarray | None = None):
        self.ids, code = np.unique(part["id"].to_numpy(), return_inverse=True)
        first = np.zeros(len(self.ids), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        self.size = [part[f"size_{k}"].to_numpy()[first] for k in range(kinds)]
        self.total = [part[f"total_{k}"].to_numpy()[first] for k in range(kinds)]
        named, kind = part["token"].to_numpy(), part["kind"].to_numpy()
        self.codes, at = np.unique(named, return_index=True) if codes is None else (codes, None)
        self.kind = None if at is None else kind[at]
        token = np.minimum(np.searchsorted(self.codes, named), len(self.codes) - 1)
        order = np.flatnonzero(self.codes[token] == named) if len(self.codes) else np.zeros(0, np.int64)
        order = order[np.argsort(code[order], kind="stable")]
        self.id, self.token, self.idf = code[order], token[order], part["idf"].to_numpy()[order]
        self.empty = sum((self.size[k] == 0).astype(np.int64) << k for k in range(kinds))


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first, lengths)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _meet(group: pd.DataFrame, kinds: int, n: int) -> pd.DataFrame:
    """The ``n`` nearest of one block for each id of the other.

    A pair's nearness is the sum over kinds of w c / (sqrt(W) sqrt(V) (c + 100)) with the number c and weight w of the
    common tokens and the weights W, V of all tokens of each, or 1 for equal sets. First all pairs are scored that share
    a token of a short posting list; the ``n``-th of them is a floor for the rest. A pair of the rest shares tokens of
    long lists only. It is looked for in the shortest list of a kind that it shares. Of a's tokens whose lists are no
    shorter let C be the number and X the weight; then the kind gives at most P / sqrt(V), P = X C / (sqrt(W) (C + 100)),
    and, as V is at least w, at most Q = sqrt(X / W) C / (C + 100). If a pair reaches the floor, some kind gives at least
    its part of it, by Q for all of a's long lists; so V is bounded, and long lists, in order of V, are read up to there.
    Their heads are read first, as they raise the floor. Sets that are equal have the same weight, so a's own is read in
    any case. Pairs without any token of a kind gain 1 by that: lists are apart by the kinds that an id lacks.
    """
    none = pd.DataFrame({"id": [], "neighbour": [], "score": []}).astype({"id": "int64", "neighbour": "int64", "score": float})
    b = _Side(group[~group["asks"]], kinds)
    a = _Side(group[group["asks"]], kinds, b.codes)
    if not len(a.id) or not len(b.id):
        return none
    kind_of = b.kind
    width, tokens = len(b.ids), len(b.codes)
    lengths = np.bincount(b.token, minlength=tokens)
    order = np.argsort(b.token, kind="stable")
    posting, start = b.id[order], np.cumsum(lengths) - lengths
    long = np.argsort(-lengths, kind="stable")[: max(1, LONG_CELLS // width)]
    long = long[lengths[long] > LONG_LIST]
    row = np.full(tokens, -1)
    row[long] = np.arange(len(long))
    is_long = row >= 0
    held = np.zeros((len(long), width), bool)
    some = is_long[b.token]
    held[row[b.token[some]], b.id[some]] = True
    # long lists by what their ids lack and then by weight
    masks = np.unique(b.empty)
    weight = np.stack(b.total)[kind_of[b.token[some]], b.id[some]]
    place = row[b.token[some]] * len(masks) + np.searchsorted(masks, b.empty[b.id[some]])
    sort = np.lexsort((weight, place))
    far_ids, far_weight = b.id[some][sort], weight[sort]
    far_size = np.bincount(place, minlength=len(long) * len(masks))
    far_start = np.cumsum(far_size) - far_size
    out = []

    def counts(x: np.ndarray, y: np.ndarray, common: np.ndarray, weight: np.ndarray) -> None:
        """Add what pairs have in common in long lists."""
        lists = a_long_size[x]
        ends = np.cumsum(lists)
        begin = 0
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELLS, side="right")))
            each = np.repeat(np.arange(begin, end), lists[begin:end])
            at = a_long[_ranges(a_long_start[x[begin:end]], lists[begin:end])]
            has = held[row[a.token[at]], y[each]]
            each, at = each[has] - begin, at[has]
            kind = kind_of[a.token[at]]
            for k in range(kinds):
                own = kind == k
                common[k, begin:end] += np.bincount(each[own], minlength=end - begin)
                weight[k, begin:end] += np.bincount(each[own], a.idf[at[own]], end - begin)
            begin = end

    def scored(x: np.ndarray, y: np.ndarray, common: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near, far = np.zeros(len(x), bool), np.zeros(len(x))
        for k in range(kinds):
            c = common[k]
            scale = np.sqrt(a.total[k][x]) * np.sqrt(b.total[k][y]) * (c + SHRINK)
            apart = np.where(c > 0, 1 - weight[k] * c / np.where(scale > 0, scale, 1), 1.0)
            far += np.where((c == a.size[k][x]) & (c == b.size[k][y]), 0.0, apart)
            near |= c > 0
        far /= kinds
        near &= far > 0
        return x[near], y[near], np.round(1 / (1 + far[near]), 6)

    def best(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((y, -score, x))
        x, y, score = x[order], y[order], score[order]
        if len(x):  # a pair that two lists gave
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            x, y, score = x[new], y[new], score[new]
        kept = np.arange(len(x)) - np.searchsorted(x, x) < n
        return x[kept], y[kept], score[kept]

    a_is_long = is_long[a.token]
    a_long = np.flatnonzero(a_is_long)
    a_long_size = np.bincount(a.id[a_long], minlength=len(a.ids))
    a_long_start = np.cumsum(a_long_size) - a_long_size
    # an id's rows of long lists by kind, the longest first; up to each row the number and weight of its kind's, P and Q
    a_long = a_long[np.lexsort((a.token[a_long], -lengths[a.token[a_long]], kind_of[a.token[a_long]], a.id[a_long]))]
    a_kind, a_of = kind_of[a.token[a_long]], a.id[a_long]
    begins = np.flatnonzero(np.r_[True, (a_of[1:] != a_of[:-1]) | (a_kind[1:] != a_kind[:-1])]) if len(a_long) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[begins, len(a_long)])
    c = np.arange(len(a_long)) - np.repeat(begins, runs) + 1
    sums = np.r_[0, np.cumsum(a.idf[a_long])]
    x = sums[1:] - np.repeat(sums[begins], runs)
    w = np.maximum(np.stack(a.total)[a_kind, a_of], 1e-300)
    row_p, row_q = x * c / (np.sqrt(w) * (c + SHRINK)), np.sqrt(np.clip(x / w, 0, 1)) * c / (c + SHRINK)
    row_q += 1e-12
    ends_of = begins + runs - 1
    most_q = np.zeros((kinds, len(a.ids)))
    most_q[a_kind[ends_of], a_of[ends_of]] = row_q[ends_of]
    alone = np.zeros(len(a_long), bool)  # the last row of a set that is in long lists altogether
    alone[ends_of] = (c[ends_of] == np.stack(a.size)[a_kind[ends_of], a_of[ends_of]]) & (kinds > 1)
    row_w = w * (1 + 1e-9)
    work = np.cumsum(np.bincount(a.id, np.where(a_is_long, 0, lengths[a.token]), len(a.ids)))
    low = 0
    while low < len(a.ids):
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + CELLS, side="right")))
        r = np.arange(*np.searchsorted(a.id, [low, high]))
        r = r[~a_is_long[r]]
        size = lengths[a.token[r]]
        cells = np.repeat(a.id[r] * width, size) + posting[_ranges(start[a.token[r]], size)]
        idf, kind = np.repeat(a.idf[r], size), np.repeat(kind_of[a.token[r]], size)
        met, at = np.unique(cells, return_inverse=True)
        common = np.stack([np.bincount(at[kind == k], minlength=len(met)) for k in range(kinds)])
        weight = np.stack([np.bincount(at[kind == k], idf[kind == k], len(met)) for k in range(kinds)])
        x, y = met // width, met % width
        counts(x, y, common, weight)
        x, y, score = best(*scored(x, y, common, weight))
        mine = slice(*np.searchsorted(a_of, [low, high]))
        for head in (True, False):
            # at least this nearness, so that the rounded score is no less than the n-th
            full = np.flatnonzero(np.bincount(x - low, minlength=high - low) >= n)
            floor, least = np.full(high - low, -np.inf), np.zeros(high - low)
            least[full] = score[np.searchsorted(x, full + low) + n - 1]
            floor[full] = kinds * (1 - (1 / (least[full] - 5.1e-7) - 1)) - 1e-9
            of, kind = a_of[mine], a_kind[mine]
            whole, part = most_q[:, of].sum(axis=0), most_q[kind, of]
            r, spot, begin, size = [], [], [], []
            for m, mask in enumerate(masks):
                lacks = np.bitwise_count(a.empty[of] & mask)
                need = (floor[of - low] - lacks) * part / whole
                upto = np.where(need <= 1e-9, np.inf, np.where(need > row_q[mine], 0, (row_p[mine] / np.maximum(need, 1e-9)) ** 2 * (1 + 1e-9)))
                upto = np.where(alone[mine], np.maximum(upto, row_w[mine]), upto)
                at = row[a.token[a_long[mine]]] * len(masks) + m
                to = _upto(far_weight, far_start[at], far_size[at], upto)
                since = np.zeros(len(to), np.int64) if head else np.minimum(to, HEAD)
                r.append(of), spot.append(at), begin.append(since), size.append((np.minimum(to, HEAD) if head else to) - since)
            r, spot, begin, size = map(np.concatenate, (r, spot, begin, size))
            used = np.flatnonzero(size > 0)
            used = used[np.argsort(r[used], kind="stable")]
            r, begin, size = r[used], far_start[spot[used]] + begin[used], size[used]
            ends, parts, k = np.cumsum(size), [(x, y, score)], 0
            while k < len(r):
                stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CELLS, side="right")))
                cells = _distinct(np.repeat(r[k:stop] * width, size[k:stop]) + far_ids[_ranges(begin[k:stop], size[k:stop])])
                cells = cells[met[np.minimum(np.searchsorted(met, cells), len(met) - 1)] != cells] if len(met) else cells
                u, v = cells // width, cells % width
                common, weight = np.zeros((kinds, len(u)), np.int64), np.zeros((kinds, len(u)))
                counts(u, v, common, weight)
                u, v, marks = scored(u, v, common, weight)
                enough = marks >= least[u - low]  # only these are sorted
                parts.append(best(u[enough], v[enough], marks[enough]))
                k = stop
            x, y, score = best(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        out.append(pd.DataFrame({"id": a.ids[x], "neighbour": b.ids[y], "score": score}))
        low = high
    return pd.concat(out) if out else none


def _upto(values: np.ndarray, first: np.ndarray, size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many values of each ascending range are at most its limit, by halving all ranges at once."""
    low, high = np.zeros(len(first), np.int64), size.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (values[np.where(open_, first + middle, 0)] <= limit)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


def auto_pairs(tag_pairs: DataFrame, user_pairs: DataFrame, tagged: DataFrame, used: DataFrame) -> DataFrame:
    """``a, b, distance``: mean of both distances over pairs near by either (RC6).

    A side on which both have nothing counts 0, one on which they share nothing 1. ``tagged`` and ``used`` are the ids that have tags or users.
    """
    both = tag_pairs.withColumnRenamed("distance", "dt").join(user_pairs.withColumnRenamed("distance", "du"), ["a", "b"], "full")
    for column, ids in (("dt", tagged), ("du", used)):
        known = ids.select("id").distinct().withColumn("has", F.lit(True))
        a, b = known.select(F.col("id").alias("a"), F.col("has").alias("has_a")), known.select(F.col("id").alias("b"), F.col("has").alias("has_b"))
        both = both.join(a, "a", "left").join(b, "b", "left")
        both = both.withColumn(column, F.coalesce(column, F.when(F.col("has_a").isNull() & F.col("has_b").isNull(), 0.0).otherwise(1.0))).drop("has_a", "has_b")
    return both.select("a", "b", ((F.col("dt") + F.col("du")) / 2).alias("distance"))


def neighbours(pairs: DataFrame, n: int, hidden: DataFrame | None = None) -> DataFrame:
    """``id, neighbour, score, rank`` of the ``n`` nearest at a distance above 0, with score 1 / (1 + distance), ties by id (RC8, RC11).

    ``hidden`` ids (``id``) have neighbours but are none (RC9).
    """
    rows = pairs.where("distance > 0")
    if hidden is not None:
        rows = rows.join(hidden.select(F.col("id").alias("b")).distinct(), "b", "left_anti")
    rows = rows.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), F.round(1 / (1 + F.col("distance")), 6).alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _blocks(rows: int) -> int:
    """Blocks of at most ``VECTOR_ROWS`` vectors, and a few of smaller collections, so that there are tasks for all cores."""
    return max(1, -(-rows // VECTOR_ROWS), min(3, rows // 1000))


def _spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Few bytes that mean much work, in as many tasks as cores can use: tasks of a fixed number aren't merged by their size."""
    return df.repartition(max(1, min(groups, 4 * df.sparkSession.sparkContext.defaultParallelism)), *keys)


def vector_neighbours(vectors: DataFrame, n: int, metric: str = "euclidean", queries: DataFrame | None = None, hidden: DataFrame | None = None, blocks: int | None = None, prune_zero: bool = True) -> DataFrame:
    """``id, neighbour, distance, rank``: exact nearest vectors of each query, in blocks (RC3, RC10, JN8, JN9, AN2, VE3).

    ``vectors`` and ``queries`` (default: the same) have ``id, vector`` of one length. Each block of queries meets each
    block of vectors once, as one matrix product, and only the ``n`` best of a block go on, so no pair table exists.
    Blocks follow from the numbers of rows. Queries with a column ``more`` get that many neighbours beyond ``n``, each
    its own number. ``metric`` is euclidean, cosine or dot (largest product first). Distances are rounded to 6 digits
    before ties are broken by id. Exact search is work in proportion to queries x vectors; beyond some ten million of
    each use ``hashed_neighbours``.
    """
    ask = vectors if queries is None else queries
    held = vectors if hidden is None else vectors.join(hidden.select("id").distinct(), "id", "left_anti")
    more = F.col("more").cast("int") if "more" in ask.columns else F.lit(0)
    rows = blocks or _blocks(ask.count())
    cols = blocks or (rows if queries is None and hidden is None else _blocks(held.count()))
    piece = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = ask.select("id", "vector", more.alias("more"), piece(rows).alias("i"), every(cols).alias("j"), F.lit(True).alias("asks"))
    right = held.select("id", "vector", F.lit(0).alias("more"), piece(cols).alias("j"), every(rows).alias("i"), F.lit(False).alias("asks")).select(*left.columns)
    same = queries is None or hidden is not None

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        q, x = group[group["asks"]].sort_values("more"), group[~group["asks"]].sort_values("id")
        if not len(q) or not len(x):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []}).astype({"id": object, "neighbour": object, "distance": float})
        return _nearest_in_block(q, x, n, metric, same, prune_zero)

    found = _spread(left.unionByName(right), rows * cols, "i", "j").groupBy("i", "j").applyInPandas(meet, "id string, neighbour string, distance double")
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(best))
    if "more" not in ask.columns:
        return ranked.where(F.col("rank") <= n)
    return ranked.join(ask.select("id", F.col("more").alias("_m")), "id").where(F.col("rank") <= n + F.col("_m")).drop("_m")


def hashed_neighbours(vectors: DataFrame, n: int, tables: int = 8, bucket_rows: int = 4000, seed: int = 0, metric: str = "cosine") -> DataFrame:
    """``id, neighbour, distance, rank`` by random hyperplanes: approximate, for collections too large for all blocks (AN1).

    In each of ``tables`` hash tables a vector is held under its sign pattern and searched for under the patterns most
    likely to hold its neighbours: its own, and those with one or two signs changed of the planes it is nearest to.
    Patterns are as long as makes buckets of about ``bucket_rows``; the patterns searched grow with the square of that
    length, as a longer one parts more neighbours. A collection so small that they would be all patterns is searched
    as one bucket, exactly. A larger bucket is searched in slices. Distances are exact and rounded, the set of
    neighbours isn't; more tables find more. Vectors have one length.
    """
    count = vectors.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "id string, neighbour string, distance double, rank int")
    bits = max(0, min(30, round(np.log2(max(1, count / bucket_rows)))))
    probes = max(1, bits * bits // 6)
    if tables * probes >= 1 << bits:
        tables, probes, bits = 1, 1, 0
    dims = vectors.select(F.size("vector").alias("d")).first()["d"]
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    flips = [[]] + [[a] for a in range(bits)] + [[a, b] for a in range(bits) for b in range(a)]
    changed = np.array([[float(a in f) for a in range(bits)] for f in flips]).reshape(len(flips), bits)
    masks = (changed.astype(np.int64) << np.arange(bits)).sum(axis=1)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start : start + 2000]
                x = np.stack(part["vector"]).astype(np.float64)
                codes, asked = [], []
                for p in planes:
                    side = x @ p.T
                    own = ((side > 0).astype(np.int64) << np.arange(bits)).sum(axis=1)
                    cost = (side / np.linalg.norm(p, axis=1)) ** 2 @ changed.T
                    codes.append(own)
                    asked.append(own[:, None] ^ masks[np.argsort(cost, axis=1, kind="stable")[:, :probes]])
                yield pd.DataFrame({"id": part["id"], "vector": part["vector"], "codes": list(np.stack(codes, axis=1)), "asked": list(np.concatenate(asked, axis=1))})

    placed = vectors.select("id", "vector").mapInPandas(sign, "id string, vector array<float>, codes array<bigint>, asked array<bigint>")
    held = placed.select("id", "vector", F.posexplode("codes").alias("t", "code"))
    asks = placed.select("id", "vector", F.posexplode("asked").alias("at", "code")).withColumn("t", F.floor(F.col("at") / probes).cast("int")).drop("at")
    pieces = lambda df, name: df.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * bucket_rows)).cast("int").alias(name))
    sizes = pieces(held, "slices").join(pieces(asks, "parts"), ["t", "code"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    asks = asks.join(sizes, ["t", "code"]).select("t", "code", "id", "vector", own("parts").alias("i"), every("slices").alias("j"), F.lit(True).alias("asks"))
    held = held.join(sizes, ["t", "code"]).select("t", "code", "id", "vector", every("parts").alias("i"), own("slices").alias("j"), F.lit(False).alias("asks"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        q, x = group[group["asks"]], group[~group["asks"]].sort_values("id")
        if not len(q) or not len(x):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []}).astype({"id": object, "neighbour": object, "distance": float})
        return _nearest_in_block(q, x, n, metric, True, True)

    groups = tables * (1 << bits) * max(1, count // (2 * bucket_rows)) ** 2
    found = _spread(asks.unionByName(held), groups, "t", "code", "i", "j").groupBy("t", "code", "i", "j").applyInPandas(meet, "id string, neighbour string, distance double").groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _nearest_in_block(q: pd.DataFrame, x: pd.DataFrame, n: int, metric: str, same: bool, prune_zero: bool) -> pd.DataFrame:
    """The ``n`` nearest of ``x``, sorted by id, for each row of ``q``, by one matrix product for 512 rows."""
    out = []
    base, ids = np.stack(x["vector"]).astype(np.float64), x["id"].to_numpy()
    square = (base**2).sum(1)
    number = np.searchsorted(ids, ids)
    for start in range(0, len(q), 512):
        some = q.iloc[start : start + 512]
        v, asking = np.stack(some["vector"]).astype(np.float64), some["id"].to_numpy()
        prod = v @ base.T
        if metric == "euclidean":
            far = np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + square - 2 * prod))
        elif metric == "cosine":
            norm = np.sqrt((v**2).sum(1))[:, None] * np.sqrt(square)
            far = np.where(norm > 0, 1 - prod / np.where(norm > 0, norm, 1), 1)
        else:
            far = -prod
        if prune_zero and metric != "dot":
            far[far * 1e6 <= 0.5] = np.inf  # 0 when rounded
        if same:
            at = np.minimum(np.searchsorted(ids, asking), len(ids) - 1)
            mine = np.where(ids[at] == asking, number[at], -1)
            far[mine[:, None] == number[None, :]] = np.inf
        # all that may be among the nearest once rounded; only these are sorted. Rows come in order of how many they want
        wanted = n + (some["more"].to_numpy() if "more" in some else np.zeros(len(some), int))
        most = int(wanted[-1])
        cut = np.full((len(some), 1), np.inf)
        if far.shape[1] > most:
            for k in np.unique(wanted):
                own = np.flatnonzero(wanted == k)
                cut[own] = np.partition(far[own], k - 1, axis=1)[:, k - 1 : k] + 1e-6
        r, c = np.nonzero((far <= cut) & np.isfinite(far))
        d = np.round(far[r, c], 6)
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < wanted[r]
        r, c, d = r[kept], c[kept], d[kept]
        out.append(pd.DataFrame({"id": asking[r], "neighbour": ids[c], "distance": d}))
    return pd.concat(out)


def prompt_neighbours(items: DataFrame, render, complete, embed, vectors: DataFrame, n: int) -> DataFrame:
    """``id, neighbour, distance, rank`` of a client's suggestions (RC7).

    ``render(row)`` makes a prompt, ``complete(prompts)`` gives a list of texts for each, ``embed(texts)`` their vectors.
    Each suggestion's nearest vectors are searched; an item's distance is multiplied by the suggestion's own to the item.
    """
    columns = items.columns

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            for row, texts in zip(rows, complete([render(r) for r in rows])):
                for k, v in enumerate(embed(texts)):
                    yield pd.DataFrame({"id": [f"{row[columns[0]]}\x1f{k}"], "vector": [np.asarray(v, np.float32)]})

    asked = items.mapInPandas(ask, "id string, vector array<float>")
    near = vector_neighbours(vectors, n, queries=asked, prune_zero=False).withColumn("owner", F.split("id", "\x1f")[0])
    own = asked.select("id", F.col("vector").alias("qv"), F.split("id", "\x1f")[0].alias("owner")).join(vectors.select(F.col("id").alias("owner"), "vector"), "owner")
    from skein.functions.vectors import euclidean

    weight = own.select("id", euclidean(F.col("qv"), F.col("vector")).alias("own"))
    scored = near.join(weight, "id").where("neighbour <> owner").groupBy("owner", "neighbour").agg(F.min(F.col("distance") * F.col("own")).alias("distance"))
    best = Window.partitionBy("owner").orderBy("distance", "neighbour")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).withColumnRenamed("owner", "id")
