"""Ids and times as the tables hold them: padded strings, null or blank ids, zoned and zoneless timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_id(col: Column | str) -> Column:
    """The id without spaces at both ends; null where nothing remains."""
    trimmed = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.when(trimmed != "", trimmed)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column, whatever the session's time zone does to zoneless ones."""
    kind = df.schema[name].dataType.typeName()
    quoted = f"`{name.replace('`', '``')}`"
    if kind in ("bigint", "long"):
        return F.col(quoted)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quoted})")
    return F.unix_micros(F.col(quoted).cast("timestamp"))


def valid_id(col: Column) -> Column:
    """Ids accepted at ingest: something remains after trimming, and there is no slash (PR17)."""
    return F.coalesce((F.trim(col) != "") & ~F.contains(col, F.lit("/")), F.lit(False))
