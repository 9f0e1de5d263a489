"""Most similar vectors for every vector, by balanced posting lists (problem 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import clean_id
from skein.lineage import Scratch


@dataclass(frozen=True)
class Lists:
    """Parameters of the posting lists of one space."""

    rows: int = 250  # vectors wanted in a list
    fit_rows: int = 200_000  # at most so many vectors are looked at to place the centroids, eight for each list
    copies: int = 4  # most lists that hold one vector
    copy_ratio: float = 1.15  # a list further than this times the nearest one doesn't get a copy
    probes: int = 10  # most lists searched for one vector
    probe_ratio: float = 1.25  # a list further than this times the nearest one isn't searched
    probe_share: float = 0.0  # or so great a share of all lists, if that is more
    slice_rows: int = 4_000  # longer lists are searched in slices of about so many rows

    def sample(self, count: int) -> int:
        """How many of ``count`` vectors place the centroids: eight for each list, some thousands at least."""
        return min(count, self.fit_rows, max(5_000, 8 * (count // self.rows + 1)))

    def wanted(self, count: int, sample: int) -> int:
        return max(1, min(count // self.rows, sample // 8))


WIDE = Lists(probes=40, probe_ratio=2.0, probe_share=1 / 16)  # for few queries that want neighbours of any distance


def balanced_centroids(x: np.ndarray, wanted: int, seed: int = 5) -> np.ndarray:
    """Means of ``wanted`` parts of equal size, halved again and again along the direction between two means, then drawn
    twice to the vectors nearest to them. Equal vectors can't be told apart and stay one part."""
    rng = np.random.default_rng(seed)
    parts = [x]
    while len(parts) < wanted:
        parts.sort(key=len)
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        a, b = p[rng.integers(len(p))], p[rng.integers(len(p))]
        for _ in range(4):
            near = p @ (a - b)
            cut = np.median(near)
            left = near > cut
            if not left.any() or left.all():
                left = np.arange(len(p)) < len(p) // 2
            a, b = p[left].mean(axis=0), p[~left].mean(axis=0)
        parts += [p[left], p[~left]]
    c = np.stack([p.mean(axis=0) for p in parts])
    for _ in range(2):
        half = (c**2).sum(axis=1) / 2
        near = np.concatenate([(x[i : i + 1000] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 1000)])
        for i in range(len(c)):
            own = x[near == i]
            if len(own):
                c[i] = own.mean(axis=0)
    return np.unique(c.astype(np.float32), axis=0)


class CentroidGraph:
    """A proximity graph over centroids in memory; vectors are searched in it by the block, a beam each."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.c = centroids
        self.half = (centroids**2).sum(axis=1) / 2
        degree = min(degree, max(1, len(centroids) - 1))
        self.links = np.zeros((len(centroids), degree), np.int64)
        for i in range(0, len(centroids), 1000):
            near = centroids[i : i + 1000] @ centroids.T - self.half
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            some = np.argpartition(-near, degree - 1, axis=1)[:, :degree] if degree < near.shape[1] else np.argsort(-near, axis=1)[:, :degree]
            self.links[i : i + 1000] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1), axis=1)
        # entry points: one in about sqrt(n) centroids, spread by taking them in an order along a direction
        order = np.argsort(centroids[:, 0], kind="stable")
        self.entries = order[:: max(1, int(math.sqrt(len(order)) / 2))]

    def search(self, x: np.ndarray, wanted: int, beam: int = 32, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of about the ``wanted`` nearest, nearest first."""
        n, total = len(x), len(self.c)
        beam = min(max(beam, wanted), total)
        norm = (x**2).sum(axis=1)
        near = x @ self.c[self.entries].T - self.half[self.entries]
        at = np.argsort(-near, axis=1)[:, :beam]
        found, score = self.entries[at], np.take_along_axis(near, at, axis=1)
        spread = 8
        seen = np.zeros((n, total), bool)
        rows = np.arange(n)[:, None]
        for _ in range(rounds):
            fresh = ~seen[rows, found]
            rank = np.cumsum(fresh, axis=1)
            go = fresh & (rank <= spread)
            if not go.any():
                break
            pick = np.argsort(~go, axis=1, kind="stable")[:, :spread]
            chosen, valid = np.take_along_axis(found, pick, axis=1), np.take_along_axis(go, pick, axis=1)
            r, k = np.nonzero(valid)
            seen[r, chosen[r, k]] = True
            more = self.links[chosen].reshape(n, -1)
            reach = np.einsum("nd,nmd->nm", x, self.c[more]) - self.half[more]
            reach[~np.repeat(valid, self.links.shape[1], axis=1)] = -np.inf
            found, score = np.concatenate([found, more], axis=1), np.concatenate([score, reach], axis=1)
            order = np.lexsort((-score, found), axis=1)
            found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
            score[:, 1:][found[:, 1:] == found[:, :-1]] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
        far = np.sqrt(np.maximum(0, norm[:, None] - 2 * score[:, :wanted]))
        far[np.isneginf(score[:, :wanted])] = np.inf
        return found[:, :wanted], far


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    """``id, vec``: vectors of exactly ``dims`` finite values, not all zero, under a trimmed non-blank id; of several
    vectors of one id the least stands."""
    rows = df.select(clean_id(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where((F.size("vec") == dims) & fine & F.exists("vec", lambda v: v != 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def nearest(vectors: DataFrame, k: int = 5, floor: float = -1.0, lists: Lists = Lists(), queries: DataFrame | None = None) -> DataFrame:
    """``id, other, cosine, rank``: for each id the ``k`` most similar other ids of cosine at least ``floor``, of equal ones the smaller id first.

    ``vectors`` has ``id, vec``, each id once, vectors usable. Ids with equal vectors are one class while searching, so
    a vector that a third of the ids share is searched once; each member then gets its own neighbours. Centroids are
    placed on eight vectors for each list, at most ``lists.fit_rows``: lists keep about ``lists.rows`` vectors up to
    some six million, and beyond grow with the collection. Every vector is then posted to its nearest list and to those nearly as
    near, and searches the lists whose distance is within a ratio of the nearest. Cosines are exact, the set of
    neighbours is approximate. Long lists are searched in slices, so none is one task's. ``queries`` (``id``) limits
    who asks, never who is found. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    members = scratch.cut(vectors.select("id", "vec"))
    by_id = Window.partitionBy("vec").orderBy("id")
    heads = members.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= k + 1)
    # of each class the k + 1 least ids are all that a list of neighbours can hold of it
    classes = heads.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = scratch.cut(classes.select("vec", "ids").sort(F.col("ids")[0]).withColumn("cid", F.monotonically_increasing_id()))
    count = classes.count()
    if not count:
        return spark.createDataFrame([], "id string, other string, cosine double, rank int")
    sample = classes.select("vec").orderBy(F.xxhash64("vec")).limit(lists.sample(count)).toPandas()
    fitted = balanced_centroids(_unit(sample["vec"]).astype(np.float32), lists.wanted(count, len(sample)))
    graph = spark.sparkContext.broadcast(CentroidGraph(fitted))  # at most fit_rows / 8 centroids
    probes = max(lists.probes, math.ceil(lists.probe_share * len(fitted)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                found, far = graph.value.search(_unit(part["vec"]).astype(np.float32), probes, rounds=12 + probes // 8)
                first = far[:, :1] + 1e-9
                yield pd.DataFrame({
                    "cid": part["cid"], "vec": part["vec"],
                    "lists": [f[d <= lists.probe_ratio * a] for f, d, a in zip(found.astype(np.int32), far, first)],
                    "posted": np.minimum(lists.copies, (far <= lists.copy_ratio * first).sum(axis=1)).astype(np.int32),
                })

    placed = scratch.cut(classes.select("cid", "vec").mapInPandas(place, "cid bigint, vec array<float>, lists array<int>, posted int"))
    asking = placed
    if queries is not None:
        asked = members.join(queries.select("id").distinct(), "id", "left_semi").select("vec").distinct().join(classes.select("vec", "cid"), "vec").select("cid")
        asking = placed.join(asked, "cid", "left_semi")
    posted = placed.select("cid", F.explode(F.slice("lists", F.lit(1), F.col("posted"))).alias("list"))
    long = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > lists.slice_rows).collect()}
    slices = F.coalesce(F.create_map(*[F.lit(x) for r in long.items() for x in (int(r[0]), math.ceil(r[1] / lists.slice_rows))])[F.col("list")], F.lit(1)) if long else F.lit(1)
    held = placed.select("cid", "vec", F.explode(F.slice("lists", F.lit(1), F.col("posted"))).alias("list")).withColumn("slice", F.pmod(F.xxhash64("cid"), slices).cast("int")).withColumn("part", F.lit(-1))
    asks = asking.select("cid", "vec", F.explode("lists").alias("list")).withColumn("n", slices)
    asks = asks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("n")).cast("int")).drop("n")
    # a sliced list's askers are split as well; each of their parts meets each slice
    held = held.withColumn("n", slices).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).drop("n").withColumn("held", F.lit(True))
    together = held.unionByName(asks.withColumn("held", F.lit(False)))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        here, there = group[group["held"]], group[~group["held"]]
        if not len(here) or not len(there):
            return pd.DataFrame({"cid": [], "other": [], "cosine": []}).astype({"cid": "int64", "other": "int64", "cosine": "float64"})
        base, ids = _unit(here["vec"]), here["cid"].to_numpy()
        order = np.argsort(ids)
        base, ids = base[order], ids[order]
        rough = base.astype(np.float32)
        out = []
        for start in range(0, len(there), 512):
            some = there.iloc[start : start + 512]
            own, asked = some["cid"].to_numpy(), _unit(some["vec"])
            if floor > -1:
                # few are near enough: single precision finds them, double precision ranks them
                r, c = np.nonzero(asked.astype(np.float32) @ rough.T >= floor - 1e-4)
                kept = own[r] != ids[c]
                r, c = r[kept], c[kept]
                cosine = np.round(np.einsum("nd,nd->n", asked[r], base[c]), 12)
                order = np.lexsort((c, -cosine, r))
                r, c, cosine = r[order], c[order], cosine[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                good = (place < k) & (cosine >= floor)
                r, c, cosine = r[good], c[good], cosine[good]
            else:
                near = np.round(asked @ base.T, 12)
                near[own[:, None] == ids[None, :]] = -2
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(near, top, axis=1)
                r, at = np.nonzero(best >= -1.5)
                c, cosine = top[r, at], best[r, at]
            out.append(pd.DataFrame({"cid": own[r], "other": ids[c], "cosine": cosine}))
        return pd.concat(out)

    found = together.groupBy("list", "slice", "part").applyInPandas(meet, "cid bigint, other bigint, cosine double").groupBy("cid", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("cid").orderBy(F.desc("cosine"), "other")
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
    # least ids of the class itself at cosine 1, then of the neighbours, as one list of k + 1 for all members
    near = found.join(classes.select(F.col("cid").alias("other"), F.col("ids").alias("theirs")), "other").select("cid", F.explode("theirs").alias("other"), "cosine")
    asking_classes = classes if queries is None else classes.join(asking.select("cid"), "cid", "left_semi")
    own = asking_classes.where("size(ids) > 1").select("cid", F.explode("ids").alias("other"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("cid").orderBy(F.desc("cosine"), "other")
    listed = near.unionByName(own).where(F.col("cosine") >= floor).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    listed = listed.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("rn", "other", "cosine"))).alias("near"))
    who = members if queries is None else members.join(queries.select("id").distinct(), "id", "left_semi")
    mine = who.join(classes.select("vec", "cid"), "vec").join(listed, "cid")
    mine = mine.select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.posexplode("near")).select("id", F.col("col.other").alias("other"), F.col("col.cosine").alias("cosine"), (F.col("pos") + 1).cast("int").alias("rank"))


def spaces(item_embeddings: DataFrame, latent_factors: DataFrame) -> dict[str, DataFrame]:
    """The usable vectors of each space: ``vector`` of item embeddings, ``user`` and ``item`` of latent factors."""
    sides = {s: latent_factors.where(F.trim("side") == s) for s in ("user", "item")}
    return {"vector": usable(item_embeddings, "item_id", "vector", 64)} | {s: usable(df, "id", "data", 48) for s, df in sides.items()}


def alike_pairs(space: str, vectors: DataFrame, k: int = 5, floor: float = 0.9) -> DataFrame:
    """``space, id_a, id_b`` of the pairs that either side has among its ``k`` nearest with cosine at least ``floor``."""
    near = nearest(vectors, k, floor)
    return near.select(F.lit(space).alias("space"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
