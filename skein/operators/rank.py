"""Ranking by a model or a client's order, and parsing what language models answer (RC18 to RC20, RC13, PR19)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\n`]*)\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)


def rank_by_score(candidates: DataFrame, score: DataFrame) -> DataFrame:
    """Candidates by a model's score per (user, item), ties by id; pairs without a score come last (RC18)."""
    rows = candidates.drop("score", "rank").join(score.select("user_id", "item_id", "score"), ["user_id", "item_id"], "left")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "item_id")))


def rank_by_client(prompts: DataFrame, rerank: Callable[[str, list[str]], list[tuple[int, float]]]) -> DataFrame:
    """``user_id, item_id, score, rank`` in the order in which ``rerank(query, documents)`` gives (index, score) (RC19).

    ``prompts`` has a row per user: ``user_id, query, item_ids, documents``, the lists bounded by the candidate limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                order = rerank(row.query, list(row.documents))
                yield pd.DataFrame({"user_id": row.user_id, "item_id": [row.item_ids[i] for i, _ in order], "score": [float(s) for _, s in order], "rank": range(1, len(order) + 1)})

    return prompts.mapInPandas(run, "user_id string, item_id string, score double, rank int")


def parse_completion(text: str) -> list[str]:
    """Names in an answer (RC20). A thought that begins it is left out.

    The first fenced block marked ``json`` or ``csv`` counts: of a JSON array its strings, and its other elements as
    JSON text; anything else marked ``json``, also what can't be parsed, as it stands; of CSV the first column, without
    blanks. Without such a block the answer's lines count, trimmed and without blank ones.
    """
    if text.startswith("<think>") and "</think>" in text:
        text = text.split("</think>", 1)[1]
    for m in _FENCE.finditer(text):
        kind, body = (m.group(2).split() or [""])[0], m.group(3)
        if kind == "json":
            if not body.startswith("["):
                return [body] if body else []
            try:
                return [x if isinstance(x, str) else json.dumps(_whole(x), separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in json.loads(body)]
            except ValueError:
                return [body]
        if kind == "csv":
            first = [line.split(",")[0].strip() for line in body.split("\n")]
            return [x for x in first if x]
    return [line.strip() for line in text.split("\n") if line.strip()]


def _whole(value: object) -> object:
    """Numbers without a fraction as whole ones, at any depth."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, list):
        return [_whole(v) for v in value]
    return {k: _whole(v) for k, v in value.items()} if isinstance(value, dict) else value


def render(template: str, **values: object) -> str:
    """A template with ``{{ name.field }}`` and ``{% for x in name %} ... {% endfor %}`` (§2.11)."""

    def look(path: str, scope: dict) -> object:
        value: object = scope
        for part in path.strip().split("."):
            value = value.get(part, "") if isinstance(value, dict) else getattr(value, part, "")
        return value

    def fill(text: str, scope: dict) -> str:
        loop = re.compile(r"\{%-?\s*for (\w+) in ([\w.]+)\s*-?%\}(.*?)\{%-?\s*endfor\s*-?%\}", re.S)
        text = loop.sub(lambda m: "".join(fill(m.group(3), scope | {m.group(1): x}) for x in look(m.group(2), scope) or []), text)
        return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: str(look(m.group(1), scope)), text)

    return fill(template, dict(values))


def external(users: DataFrame, script: Callable[[str], list[str]]) -> DataFrame:
    """``user_id, item_id, score, rank``: the ids a callable gives for each user, score 0 (RC13)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for user in batch["user_id"]:
                ids = list(dict.fromkeys(script(user)))
                yield pd.DataFrame({"user_id": user, "item_id": pd.Series(ids, dtype=object), "score": 0.0, "rank": range(1, len(ids) + 1)})

    return users.select("user_id").mapInPandas(run, "user_id string, item_id string, score double, rank int")


def enriched(scored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Scores with the row of their item or user; those without one leave (PR19)."""
    return scored.join(rows, key)
