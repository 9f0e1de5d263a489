"""Labels as terms: flattening, conversion, pruning and validation (PR12 to PR18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(kind: T.DataType, column: Column, prefix: str):
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, column.getField(f.name), f"{prefix}.{f.name}" if prefix else f.name)
    else:
        yield prefix, kind, column


def _prefixed(column: Column, prefix: str) -> Column:
    return F.transform(column, lambda v: F.concat(F.lit(prefix), v))


def flatten(df: DataFrame, id: str, labels: str) -> DataFrame:
    """``id, label``: one row per string leaf or string list element, as ``path:value`` (PR12). Nulls give none; repeats stay."""
    parts = []
    for path, kind, col in _leaves(df.schema[labels].dataType, F.col(f"`{labels}`"), ""):
        if isinstance(kind, T.StringType):
            parts.append(F.array(F.concat(F.lit(f"{path}:"), col)))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(_prefixed(col, f"{path}:"))
    none = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none
    return df.select(F.col(f"`{id}`").alias("id"), F.explode(joined).alias("label")).where("label is not null")


def weighted(df: DataFrame, id: str, labels: str) -> DataFrame:
    """``id, name, weight``: strings as ``path.value`` of weight 1, numbers as ``path.`` of their own value; number lists are left out (PR13)."""
    parts = []
    for path, kind, col in _leaves(df.schema[labels].dataType, F.col(f"`{labels}`"), ""):
        pair = lambda n, w: F.struct(n.alias("name"), w.cast("double").alias("weight"))
        if isinstance(kind, T.StringType):
            parts.append(F.when(col.isNotNull(), F.array(pair(F.concat(F.lit(f"{path}."), col), F.lit(1.0)))))
        elif isinstance(kind, T.NumericType):
            parts.append(F.when(col.isNotNull(), F.array(pair(F.lit(f"{path}."), col))))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.transform(_prefixed(F.filter(col, lambda v: v.isNotNull()), f"{path}."), lambda v: pair(v, F.lit(1.0))))
    none = F.array().cast("array<struct<name:string,weight:double>>")
    joined = F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none
    return df.select(F.col(f"`{id}`").alias("id"), F.explode(joined).alias("x")).select("id", "x.name", "x.weight")


def embeddings(df: DataFrame, id: str, labels: str) -> DataFrame:
    """``id, name, vector``: number lists, named by their path (PR14)."""
    found = None
    for path, kind, col in _leaves(df.schema[labels].dataType, F.col(f"`{labels}`"), ""):
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            part = df.select(F.col(f"`{id}`").alias("id"), F.lit(path).alias("name"), col.cast("array<float>").alias("vector")).where("vector is not null")
            found = part if found is None else found.unionByName(part)
    return found if found is not None else df.sparkSession.createDataFrame([], "id string, name string, vector array<float>")


def pruned(labels: DataFrame) -> DataFrame:
    """Rows of labels that occur at least twice in all, repeats counted (PR15)."""
    often = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("label")
    return labels.join(often, "label", "left_semi").select(*labels.columns)


def modal_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of non-null vectors, of equal ones the smaller (PR16); 0 without any."""
    row = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0


def valid_labels(value: object) -> bool:
    """Whether a decoded JSON value may be labels: strings, numbers, lists all of one of them, and maps of such (PR18)."""
    if value is None or isinstance(value, str) or (isinstance(value, (int, float)) and not isinstance(value, bool)):
        return True
    if isinstance(value, list):
        if not value:
            return True
        first = str if isinstance(value[0], str) else (int, float)
        return all(isinstance(v, first) and not isinstance(v, bool) for v in value)
    return isinstance(value, dict) and all(valid_labels(v) for v in value.values())
