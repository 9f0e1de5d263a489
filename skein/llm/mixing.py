"""Mixing sources to target weights by Pfair scheduling (problem 9)."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.lineage import Scratch
from skein.llm.tokenizer import count_tokens

BLOCKS = 1000  # blocks of one mix; their size follows from the mix's total
BUCKET_ROWS = 50_000


def source_name(col: Column) -> Column:
    """Sources in one spelling: trimmed, lower case, hyphens and inner spaces as underscores; blanks are null."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"[-\s]+", "_")
    return F.when(name != "", name)


def fill(weights: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """Split ``total`` by weight; what a source can't give beyond its limit goes to the others by their weights."""
    got = dict.fromkeys(weights, 0.0)
    open_ = {s for s, w in weights.items() if w > 0 and limits.get(s, 0) > 0}
    left = total
    while open_ and left > 1e-9 * max(total, 1):
        scale = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * scale >= limits[s]}
        if not full:
            return got | {s: weights[s] * scale for s in open_}
        for s in full:
            got[s] = limits[s]
            left -= limits[s]
        open_ -= full
    return got


def pfair_slots(blocks: dict[tuple[str, int], int]) -> dict[tuple[str, int], int]:
    """Slot of each (source, block number) of one mix, from the blocks' sizes in tokens.

    A source of weight w (its part of the total) whose blocks before this one hold c tokens may start the block once
    c / w tokens have gone out and has to end it by (c + its size) / w. Of the started ones that with the earliest
    deadline goes next (then the later start, then the source's name). As the sources' leads and lags add up to
    nothing, one may always start; no source is ever further from its share of what has gone out than the largest block.
    """
    queues: dict[str, list[tuple[int, int]]] = {}
    for (s, j), size in sorted(blocks.items()):
        queues.setdefault(s, []).append((j, size))
    sizes = {s: sum(n for _, n in q) for s, q in queues.items()}
    total = sum(sizes.values())
    given = dict.fromkeys(queues, 0)
    place = dict.fromkeys(queues, 0)
    ready: list[tuple[float, float, str]] = []
    waiting = [(0.0, s) for s in queues if sizes[s]]
    heapq.heapify(waiting)
    slots: dict[tuple[str, int], int] = {}
    out = 0
    while waiting or ready:
        while waiting and (waiting[0][0] <= out * (1 + 1e-12) or not ready):
            start, s = heapq.heappop(waiting)
            heapq.heappush(ready, ((given[s] + queues[s][place[s]][1]) * total / sizes[s], -start, s))
        _, _, s = heapq.heappop(ready)
        j, size = queues[s][place[s]]
        slots[s, j] = len(slots)
        out, given[s], place[s] = out + size, given[s] + size, place[s] + 1
        if place[s] < len(queues[s]):
            heapq.heappush(waiting, (given[s] * total / sizes[s], s))
    return slots


def refill(gap: float, lengths: dict[int, int]) -> dict[int, int]:
    """How many texts of each length to add so that ``gap`` tokens are missed by half the shortest text left at most.

    ``lengths`` has the number of texts at hand by length. The longest that fits goes first; at last the shortest one
    left if that comes nearer.
    """
    taken: dict[int, int] = {}
    for n in sorted(lengths, reverse=True):
        k = min(lengths[n], int(gap // n))
        if k:
            taken[n] = k
            gap -= k * n
    rest = [n for n in lengths if lengths[n] > taken.get(n, 0)]
    if rest and min(rest) < 2 * gap:
        taken[min(rest)] = taken.get(min(rest), 0) + 1
    return taken


def _targets(targets: DataFrame) -> dict[str, dict]:
    """The mixes; the table is configuration, a row for each mix and source."""
    share = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)
    rows = (
        targets.select("mix_name", source_name(F.col("source")).alias("source"), F.when(F.isnan(share) | (share == float("inf")), 0.0).otherwise(share).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats"), F.coalesce("size_share", F.lit(1.0)).alias("size"))
        .where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats"), F.max("size").alias("size"))
    ).collect()
    mixes: dict[str, dict] = {}
    for r in sorted(rows):
        mix = mixes.setdefault(r["mix_name"], {"size": 0.0, "sources": {}})
        mix["size"] = max(mix["size"], r["size"])
        mix["sources"][r["source"]] = (r["share"], r["repeats"])
    return mixes


class Mixture:
    """Selections of documents for every mix of ``targets``.

    Sizes are tokens. The total wanted of a mix is ``size_share`` of the tokens of all documents. Shares are divided
    by their sum over the sources that have texts; null, negative, NaN and infinite shares are 0, repeated targets of
    a source add up. A source gives at most ``max_repeats`` times its distinct texts; what is then missing comes from
    the others by their weights, and if all are used up the mix stays short. Copies of a text are one text of a mix:
    that of the smallest ``doc_id`` among the sources that this mix gives a share above 0, so no text is used more
    than its source's ``max_repeats`` times and other mixes change nothing. Documents whose text is null or empty, or
    whose source no mix names, aren't used.

    Texts of a source go in order of their hash, over and over, as long as they fit the wanted size; the rest is
    filled with texts of lengths that fit it, so a source misses its size by half of its shortest text left at most.
    A block is the whole texts that start within the next thousandth of the mix; ``plan.block`` is the size of the
    largest one. Read by (slot, start), a mix never has a source further from its share than one such block. Empty
    tables give no rows.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, blocks: int = BLOCKS, vocabulary: tuple[str, str] | None = None):
        spark = documents.sparkSession
        scratch = Scratch(spark, "mix")
        mixes = _targets(targets)
        rows = documents.select("doc_id", source_name(F.col("source").cast("string")).alias("source"), F.md5("text").alias("text_key"), F.col("text").cast("string").alias("text"))
        sized = scratch.cut(count_tokens(rows, "text", vocabulary=vocabulary))
        corpus = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
        named = spark.createDataFrame([(mix, s) for mix, m in mixes.items() for s, (share, _) in m["sources"].items() if share > 0], "mix_name string, source string")
        texts = (
            sized.where("n_tokens > 0 and doc_id is not null").join(F.broadcast(named), "source")  # as many rows as targets
            .groupBy("mix_name", "text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("first"))
            .select("mix_name", "first.*", F.xxhash64("text_key").alias("h"))
        )
        texts = scratch.cut(texts)
        stock = {(r["mix_name"], r["source"]): r for r in texts.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
        plan, todo = [], []
        for mix, m in mixes.items():
            supply = {s: stock[mix, s]["size"] for s in m["sources"] if (mix, s) in stock}
            wanted = fill({s: m["sources"][s][0] for s in supply}, {s: supply[s] * m["sources"][s][1] for s in supply}, m["size"] * corpus)
            all_shares = sum(share for share, _ in m["sources"].values()) or 1.0
            for s, (share, repeats) in m["sources"].items():
                plan.append((mix, s, share / all_shares, repeats, stock[mix, s]["n"] if s in supply else 0, supply.get(s, 0), float(wanted.get(s, 0))))
                if wanted.get(s, 0) > 0:
                    todo.append((mix, s, repeats, supply[s], float(wanted[s]), max(1, math.ceil(sum(wanted.values()) / blocks))))
        todo = spark.createDataFrame(todo, "mix_name string, source string, repeats int, supply long, wanted double, quantum long")
        # offsets of texts in their source's order, which is by hash: sums of buckets first, then within each bucket
        buckets = max(16, math.ceil(max((r["n"] for r in stock.values()), default=0) / BUCKET_ROWS) * 2)
        placed = texts.withColumn("bucket", F.pmod(F.shiftright("h", 16), F.lit(buckets)))
        sums = placed.groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("size"))
        ahead = sums.withColumn("ahead", F.sum("size").over(Window.partitionBy("mix_name", "source").orderBy("bucket")) - F.col("size")).drop("size")
        inner = Window.partitionBy("mix_name", "source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(ahead, ["mix_name", "source", "bucket"])
        placed = placed.select("mix_name", "source", "doc_id", "n_tokens", "h", (F.col("ahead") + F.col("within")).alias("at"))
        placed = scratch.cut(placed.join(F.broadcast(todo), ["mix_name", "source"]))  # as many rows as targets
        uses = placed.withColumn("use_no", F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.col("wanted") / F.col("supply")), F.col("repeats")).cast("int") - 1)))
        uses = uses.withColumn("start", F.col("use_no") * F.col("supply") + F.col("at")).where("start + n_tokens <= wanted")
        keep = ["mix_name", "source", "doc_id", "n_tokens", "use_no", "start", "quantum"]
        prefix = uses.select(*keep)
        extra = self._extra(placed, prefix, todo)
        chosen = scratch.cut(prefix if extra is None else prefix.unionByName(extra.select(*keep)))
        chosen = chosen.withColumn("block_no", F.floor(F.col("start") / F.col("quantum")))
        sizes: dict[str, dict[tuple[str, int], int]] = {}
        for r in chosen.groupBy("mix_name", "source", "block_no").agg(F.sum("n_tokens").alias("n")).collect():  # about blocks + sources rows a mix
            sizes.setdefault(r["mix_name"], {})[r["source"], r["block_no"]] = r["n"]
        slots = [(mix, s, j, slot) for mix, own in sizes.items() for (s, j), slot in pfair_slots(own).items()]
        largest = {mix: max(own.values()) for mix, own in sizes.items()}
        self.plan = spark.createDataFrame([(*p, largest.get(p[0], 0)) for p in plan], "mix_name string, source string, target_share double, max_repeats int, texts long, supply long, wanted double, block long")
        slots = spark.createDataFrame(slots, "mix_name string, source string, block_no long, slot int")
        self.selection = chosen.join(F.broadcast(slots), ["mix_name", "source", "block_no"]).select(
            "mix_name", "slot", "start", "doc_id", "source", (F.col("use_no") + 1).alias("use_no"), "n_tokens"
        )

    @staticmethod
    def _extra(placed: DataFrame, prefix: DataFrame, todo: DataFrame) -> DataFrame | None:
        """Texts that fill what the last whole text of each source's order left open, taken from the rest of that round."""
        spark = placed.sparkSession
        ends = todo.join(prefix.groupBy("mix_name", "source").agg(F.max(F.col("start") + F.col("n_tokens")).alias("end")), ["mix_name", "source"], "left").na.fill(0, ["end"])
        ends = [(*r[:2], r["end"] // r["supply"], r["end"] % r["supply"], r["end"], r["wanted"] - r["end"]) for r in ends.collect() if r["wanted"] - r["end"] >= 0.5 and r["end"] // r["supply"] < r["repeats"]]
        if not ends:
            return None
        gaps = spark.createDataFrame(ends, "mix_name string, source string, use_no int, done long, end long, gap double")
        rest = placed.join(F.broadcast(gaps), ["mix_name", "source"]).where("at >= done and n_tokens < 2 * gap")
        lengths: dict[tuple[str, str], dict[int, int]] = {}
        for r in rest.groupBy("mix_name", "source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each length below twice a text's
            lengths.setdefault((r["mix_name"], r["source"]), {})[r["n_tokens"]] = r["n"]
        take = [(e[0], e[1], n, k) for e in ends for n, k in refill(e[5], lengths.get(e[:2], {})).items()]
        if not take:
            return None
        wanted = spark.createDataFrame(take, "mix_name string, source string, n_tokens long, take int")
        rank = F.row_number().over(Window.partitionBy("mix_name", "source", "n_tokens").orderBy("h", "doc_id"))
        some = rest.join(F.broadcast(wanted), ["mix_name", "source", "n_tokens"]).withColumn("rn", rank).where(F.col("rn") <= max(k for *_, k in take)).where("rn <= take")
        before = Window.partitionBy("mix_name", "source").orderBy(F.desc("n_tokens"), "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        return some.withColumn("start", F.col("end") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def stocks(self) -> DataFrame:
        """``mix_name, source, target_share, max_repeats, texts`` of every target: its part of the mix and its distinct texts there."""
        return self.plan.select("mix_name", "source", "target_share", "max_repeats", "texts")

    def shares(self) -> DataFrame:
        """``mix_name, source, target_share, wanted_tokens, tokens, share, docs, most_uses`` of every target, used or not."""
        used = self.selection.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("docs"), F.max("use_no").alias("most_uses"))
        filled = self.plan.join(used, ["mix_name", "source"], "left").na.fill(0, ["tokens", "docs", "most_uses"])
        total = F.sum("tokens").over(Window.partitionBy("mix_name"))
        return filled.select("mix_name", "source", "target_share", F.round("wanted").cast("long").alias("wanted_tokens"), "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"), "docs", "most_uses")
