"""Factorization machines for click-through: one of hashed labels, trained in blocks, and one with attention over embeddings (MD7 to MD9)."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.lineage import Scratch
from skein.models.tensor import Adam, Attention, Linear, Tensor, bce_with_logits

DIMS = 1 << 18
ID_ROWS, LEAST_BLOCKS = 150_000, 3  # users or items of a block, and blocks of each
SPAN = 1 << 16  # positions whose parameters are kept together


def hashed_features(samples: DataFrame, user_labels: DataFrame, item_labels: DataFrame, dims: int = DIMS) -> DataFrame:
    """``user_id, item_id, target, pairs``: hashed one-hot ids and weighted labels as (position, value).

    Label tables have ``id, name, weight``. Hashing needs no dictionary, so features of new ids cost nothing and no index grows with the data.
    """
    named = lambda df, p: df.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit(p), "name").alias("k"), F.col("weight")))).alias(f"{p}m"))
    u, i = named(user_labels.groupBy("id", "name").agg(F.max("weight").alias("weight")), "u_"), named(item_labels.groupBy("id", "name").agg(F.max("weight").alias("weight")), "i_")
    rows = samples.join(u.withColumnRenamed("id", "user_id"), "user_id", "left").join(i.withColumnRenamed("id", "item_id"), "item_id", "left")
    none = F.create_map().cast("map<string,double>")
    terms = F.concat(
        F.array(F.struct(F.concat(F.lit("user="), "user_id").alias("k"), F.lit(1.0).alias("w")), F.struct(F.concat(F.lit("item="), "item_id").alias("k"), F.lit(1.0).alias("w"))),
        F.transform(F.map_entries(F.coalesce("u_m", none)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("w"))),
        F.transform(F.map_entries(F.coalesce("i_m", none)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("w"))),
    )
    pairs = F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(t["k"]), F.lit(dims)).cast("int").alias("i"), t["w"].alias("w")))
    return rows.select("user_id", "item_id", "target", F.array_sort(pairs).alias("pairs"))


def side_features(ids: DataFrame, labels: DataFrame, kind: str, dims: int = DIMS) -> DataFrame:
    """``id, pairs`` of distinct ``ids`` of one kind (``user``, ``item``): the part of ``hashed_features`` that is the same in all its samples."""
    named = labels.groupBy("id", "name").agg(F.max("weight").alias("w")).select("id", F.concat(F.lit(f"{kind[0]}_"), "name").alias("k"), "w")
    terms = named.join(ids, "id", "left_semi").unionByName(ids.select("id", F.concat(F.lit(f"{kind}="), "id").alias("k"), F.lit(1.0).alias("w")))
    pair = F.struct(F.pmod(F.xxhash64("k"), F.lit(dims)).cast("int").alias("i"), "w")
    return terms.groupBy("id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))


@dataclass
class FactorMachine:
    """``table`` has ``i, w, v`` of the positions met in training, the intercept at ``numFeatures``; ``users`` and ``items`` have ``id, pairs``."""

    table: DataFrame
    users: DataFrame
    items: DataFrame
    numFeatures: int
    factors: int
    iterations: int

    def getFactorSize(self) -> int:
        return self.factors

    def getMaxIter(self) -> int:
        return self.iterations


MESSAGE = "to string, kind string, src string, data binary"


def _step(messages: DataFrame, work: Callable) -> DataFrame:
    """Each receiver works on all messages to it, ``{kind: {src: arrays}}`` in a fixed order, so that sums are the same at each run."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = defaultdict(dict)
        for kind, src, data in sorted(zip(rows["kind"], rows["src"], rows["data"]), key=lambda r: r[:2]):
            held[kind][src] = pickle.loads(data)
        return pd.DataFrame([(to, kind, src, pickle.dumps(arrays, 5)) for to, kind, src, arrays in work(rows["to"].iloc[0], held)], columns=["to", "kind", "src", "data"])

    return messages.groupBy("to").applyInPandas(run, MESSAGE)


def _columns(rows: np.ndarray, n: int, *values: np.ndarray) -> np.ndarray:
    """Sums by row of each of the values."""
    return np.stack([np.bincount(rows, x, n) for x in values], axis=1)


def initial(seed: int, owner: int, n: int, factors: int) -> np.ndarray:
    """First factors of all positions of an owner."""
    return np.random.default_rng([seed, owner]).normal(0, 0.01, (n, factors))


def train_fm(train: DataFrame, users: DataFrame, items: DataFrame, dims: int = DIMS, factors: int = 8, iterations: int = 20, rate: float = 0.05, reg: float = 0.0002, seed: int = 0) -> FactorMachine:
    """A second-order machine on ``user_id, item_id, target``, fitted by AdamW on the mean logistic loss of all rows (MD8).

    ``users`` and ``items`` have ``id, pairs``. It is what ``FMClassifier(solver="adamW")`` fits, whose driver holds
    several copies of all parameters; here nothing that follows the rows or positions is sent to the driver. A row's
    sums are its user's and its item's, so blocks of ids sum their parameters, which come from the owners of
    positions; each pair of blocks goes through its rows; slopes go back the same way. Each task holds some blocks.
    Features at one position share its parameters but are kept apart: their values aren't added up.
    """
    scratch = Scratch(train.sparkSession, "machine")
    rows, owners = scratch.cut(train.select("user_id", "item_id", (F.col("target") > 0).cast("double").alias("y"))), max(1, dims // SPAN)
    total, blocks, places, found = rows.count(), {}, {}, []

    def features(side: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(part: pd.DataFrame) -> pd.DataFrame:
            to, out = f"{side}{part['b'].iloc[0]}", []
            n, row, i, x = int(part["n"].max()) + 1, part["n"].to_numpy(), part["i"].to_numpy(), part["w"].to_numpy()
            if side == "u":  # the intercept is a feature of every user
                own = np.unique(row)
                row, i, x = np.concatenate([row, own]), np.concatenate([i, np.full(len(own), dims)]), np.concatenate([x, np.ones(len(own))])
            for k in np.unique(i % owners):
                some = np.flatnonzero(i % owners == k)
                at, slot = np.unique(i[some] // owners, return_inverse=True)
                out.append((to, "features", f"p{k}", pickle.dumps((n, row[some].astype(np.int32), slot.astype(np.int32), x[some], at), 5)))
            return pd.DataFrame(out, columns=["to", "kind", "src", "data"])

        return run

    for side, table, column in (("u", users, "user_id"), ("i", items, "item_id")):
        ids = scratch.cut(rows.select(F.col(column).alias("id")).distinct())
        blocks[side] = max(LEAST_BLOCKS, -(-ids.count() // ID_ROWS))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks[side])).cast("int")
        places[side] = scratch.cut(ids.withColumn("b", block).withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1))
        held = places[side].join(table.hint("merge"), "id").select("b", "n", F.explode("pairs").alias("p"))
        found.append(held.select("b", "n", F.col("p.i").cast("long").alias("i"), "p.w").where("w <> 0").groupBy("b").applyInPandas(features(side), MESSAGE))
    static = scratch.cut(found[0].unionByName(found[1]))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        to = f"g{part['bu'].iloc[0]},{part['bi'].iloc[0]}"
        data = pickle.dumps((part["u"].to_numpy(np.int32), part["i"].to_numpy(np.int32), part["y"].to_numpy(np.int8)), 5)
        return pd.DataFrame([(to, "rows", to, data)], columns=["to", "kind", "src", "data"])

    place = lambda side, column: places[side].select(F.col("id").alias(column), F.col("b").alias(f"b{side}"), F.col("n").alias(side)).hint("merge")
    met = rows.join(place("u", "user_id"), "user_id").join(place("i", "item_id"), "item_id")
    met = scratch.cut(met.select("bu", "bi", "u", "i", "y").groupBy("bu", "bi").applyInPandas(packed, MESSAGE))

    def sums(to: str, held: dict):
        out = 0
        for src, (n, row, slot, x, _) in held["features"].items():
            theta = held["theta"][src][0]
            square = (theta[:, 1:] ** 2).sum(axis=1)
            out = out + _columns(row, n, *(x * theta[slot, c] for c in range(factors + 1)), x * x * square[slot])
        other = blocks["i" if to[0] == "u" else "u"]
        for k in range(other):
            yield (f"g{to[1:]},{k}" if to[0] == "u" else f"g{k},{to[1:]}"), "sums", to, (out,)

    def slopes(to: str, held: dict):
        if "rows" not in held:
            return
        bu, bi = to[1:].split(",")
        (u, i, y), (of_u,), (of_i,) = held["rows"][to], held["sums"][f"u{bu}"], held["sums"][f"i{bi}"]
        to_u, to_i = np.zeros((len(of_u), factors + 1)), np.zeros((len(of_i), factors + 1))
        for start in range(0, len(y), 50_000):
            a, b = u[start : start + 50_000], i[start : start + 50_000]
            both = of_u[a] + of_i[b]
            s = both[:, 1:-1]
            raw = both[:, 0] + 0.5 * ((s * s).sum(axis=1) - both[:, -1])
            off = 1 / (1 + np.exp(-np.clip(raw, -700, 700))) - y[start : start + 50_000]
            each = [off, *(off * s[:, f] for f in range(factors))]
            to_u += _columns(a, len(of_u), *each)
            to_i += _columns(b, len(of_i), *each)
        yield f"u{bu}", "slopes", to, (to_u,)
        yield f"i{bi}", "slopes", to, (to_i,)

    def shares(to: str, held: dict):
        by_id = sum(g for (g,) in held["slopes"].values()) / total
        for src, (_, row, slot, x, at) in held["features"].items():
            yield src, "slopes", to, (at, _columns(slot, len(at), *(x * by_id[row, c] for c in range(factors + 1)), x * x * by_id[row, 0]))

    def asked(to: str, held: dict):
        for src, (_, _, _, _, at) in held["features"].items():
            yield src, "slopes", to, (at, None)

    def update(turn: int):
        def work(to: str, held: dict):
            owner = int(to[1:])
            if not turn:
                at = np.unique(np.concatenate([a for a, _ in held["slopes"].values()]))
                theta = np.concatenate([np.zeros((len(at), 1)), initial(seed, owner, dims // owners + 1, factors)[at]], axis=1)
                theta[at * owners + owner == dims] = 0
                m, v = np.zeros_like(theta), np.zeros_like(theta)
            else:
                at, theta, m, v = held["state"][to]
                g = np.zeros((len(at), factors + 2))
                for a, x in held["slopes"].values():
                    g[np.searchsorted(at, a)] += x
                g[:, 1:-1] -= theta[:, 1:] * g[:, -1:]
                g = g[:, :-1]
                g[at * owners + owner == dims, 1:] = 0
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                theta = theta - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8) - reg * theta
            yield to, "state", to, (at, theta, m, v)
            for src, (a, _) in held["slopes"].items():
                yield src, "theta", to, (theta[np.searchsorted(at, a)],)

        return work

    state, path = scratch.write(_step(_step(static, asked), update(0)))
    for turn in range(1, iterations + 1):
        by_block = _step(static.unionByName(state.where("kind = 'theta'")), sums)
        by_id = _step(met.unionByName(by_block), slopes)
        by_owner = _step(static.unionByName(by_id), shares)
        state, new = scratch.write(_step(by_owner.unionByName(state.where("kind = 'state'")), update(turn)))
        scratch.drop(path)
        path = new

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for to, data in zip(batch["to"], batch["data"]):
                at, theta, _, _ = pickle.loads(data)
                yield pd.DataFrame({"i": at * owners + int(to[1:]), "w": theta[:, 0], "v": list(theta[:, 1:])})

    table = scratch.cut(state.where("kind = 'state'").select("to", "data").mapInPandas(unpacked, "i long, w double, v array<double>"))
    return FactorMachine(table, users, items, dims, factors, iterations)


def scores(model: FactorMachine, rows: DataFrame) -> DataFrame:
    """``user_id, item_id, target, score``: logits (MD9). Positions that training didn't meet add nothing."""
    known, x = model.table.hint("merge"), F.col("p.w")

    def summed(side: DataFrame, ids: DataFrame) -> DataFrame:
        each = side.join(ids.hint("merge"), "id", "left_semi").select("id", F.explode("pairs").alias("p")).withColumn("i", F.col("p.i").cast("long")).join(known.withColumnRenamed("w", "weight"), "i")
        square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
        return each.groupBy("id").agg(F.sum(x * F.col("weight")).alias("w"), *(F.sum(x * F.col("v")[f]).alias(f"s{f}") for f in range(model.factors)), F.sum(x * x * square).alias("q"))

    out = rows.select("user_id", "item_id", "target")
    for side, column in ((model.users, "user_id"), (model.items, "item_id")):
        part = summed(side, rows.select(F.col(column).alias("id")).distinct())
        out = out.join(part.select(F.col("id").alias(column), F.struct("w", "q", *(f"s{f}" for f in range(model.factors))).alias(column[0])).hint("merge"), column, "left")
    both = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0.0)) + F.coalesce(F.col(f"i.{c}"), F.lit(0.0))
    squares = sum((both(f"s{f}") * both(f"s{f}") for f in range(model.factors)), F.lit(0.0))
    start = model.table.where(F.col("i") == model.numFeatures).agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("start"))  # one number
    return out.crossJoin(F.broadcast(start)).select("user_id", "item_id", "target", (F.col("start") + both("w") + 0.5 * (squares - both("q"))).alias("score"))


class AttentiveMachine:
    """``b + sum w x + 1/2 sum((V x)^2 - V^2 x^2) + sum_e <V x, Linear(Attention(e))>`` on padded rows of (position, value) (MD7).

    ``fit`` is NumPy on the driver, for a bounded sample of rows; ``transform`` scores tables of any size.
    """

    def __init__(self, dims: int, factors: int = 16, embedding: int = 0, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.b, self.w = Tensor(np.zeros(1), trainable=True), Tensor(np.zeros((dims, 1)), trainable=True)
        self.v = Tensor(rng.normal(0, 0.01, (dims, factors)), trainable=True)
        self.attention = Attention(embedding, factors, rng) if embedding else None
        self.linear = Linear(embedding, factors, rng) if embedding else None

    def parameters(self) -> list[Tensor]:
        return [self.b, self.w, self.v] + (self.attention.parameters() + self.linear.parameters() if self.attention else [])

    def __call__(self, at: np.ndarray, value: np.ndarray, embeddings: np.ndarray | None = None) -> Tensor:
        x = Tensor(value[:, :, None])
        vx = self.v.take(at) * x
        total = vx.sum(axis=1)
        out = self.b + (self.w.take(at) * x).sum(axis=1).sum(axis=1) + ((total * total).sum(axis=1) - (vx * vx).sum(axis=1).sum(axis=1)) * 0.5
        if self.attention is not None and embeddings is not None:
            out = out + (total * self.linear(self.attention(Tensor(embeddings)))).sum(axis=1)
        return out

    def fit(self, at: np.ndarray, value: np.ndarray, target: np.ndarray, embeddings: np.ndarray | None = None, epochs: int = 20, rate: float = 0.01, decay: float = 0.0002, batch: int = 1024, seed: int = 0) -> list[float]:
        rng, adam, losses = np.random.default_rng(seed), Adam(self.parameters(), rate, decay), []
        for _ in range(epochs):
            order, total = rng.permutation(len(target)), 0.0
            for k in range(0, len(order), batch):
                r = order[k : k + batch]
                loss = bce_with_logits(self(at[r], value[r], None if embeddings is None else embeddings[r]), target[r])
                loss.backward()
                adam.step()
                total += float(loss.data) * len(r)
            losses.append(total / len(order))
        return losses

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (``user_id, item_id, pairs``) with ``score``, by Arrow batches; the model goes along as one broadcast.

        A model with attention needs the column ``embeddings``, a list of vectors for each row; a row without any gets
        no such term. Rows are padded to the longest of their batch, none is cut.
        """
        wide = self.attention is not None
        if wide and "embeddings" not in df.columns:
            raise ValueError("the model was made for embeddings, and there is no such column")
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                score = sent.value.scores(batch["pairs"], batch["embeddings"] if wide else None)
                yield pd.DataFrame({"user_id": batch["user_id"], "item_id": batch["item_id"], "score": score})

        columns = ["user_id", "item_id", "pairs", *(["embeddings"] if wide else [])]
        return df.select(*columns).mapInPandas(run, "user_id string, item_id string, score double")

    def scores(self, pairs, embeddings=None) -> np.ndarray:
        """Logits of rows of (position, value) pairs and, where there are, lists of vectors."""
        at, value = padded(pairs)
        if embeddings is None:
            return self(at, value).data.astype(float)
        counts = np.array([0 if e is None else len(e) for e in embeddings])
        out = np.zeros(len(counts))
        for n in np.unique(counts):  # rows with as many vectors go together, as attention weighs a row's own ones
            r = np.flatnonzero(counts == n)
            some = np.array([[list(v) for v in embeddings.iloc[k]] for k in r], np.float32) if n else None
            out[r] = self(at[r], value[r], some).data
        return out

    def save(self, path: str) -> None:
        """Every parameter as an array of one file (MD14)."""
        attends = self.attention is not None
        np.savez(path, dims=self.w.data.shape[0], factors=self.v.data.shape[1], embedding=self.linear.parameters()[0].data.shape[0] if attends else 0, **{f"p{i}": p.data for i, p in enumerate(self.parameters())})

    @classmethod
    def load(cls, path: str) -> AttentiveMachine:
        with np.load(path) as held:
            made = cls(int(held["dims"]), int(held["factors"]), int(held["embedding"]))
            for i, p in enumerate(made.parameters()):
                p.data = held[f"p{i}"]
        return made


def padded(rows) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of all pairs, rows filled up with position 0 and value 0 to the longest."""
    width = max(1, max(map(len, rows), default=1))
    at, value = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.float32)
    for k, pairs in enumerate(rows):
        for j, p in enumerate(pairs):
            at[k, j], value[k, j] = p["i"], p["w"]
    return at, value
