"""Feedback-type expressions, category matches and time limits as Columns, which Catalyst pushes to the scan."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = re.compile(r"([^<>=]+)(?:(<=|>=|<|>|=)(.+))?")
_OPS = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


@dataclass(frozen=True)
class TypeExpression:
    """``type``, or ``type`` with a comparison of the value, such as ``star>=3`` (PR1)."""

    feedback_type: str
    op: str = ""
    value: float = 0.0

    @classmethod
    def parse(cls, text: str, allow_equals: bool = False) -> TypeExpression:
        """``=`` parses but compares nothing; it is refused unless ``allow_equals``."""
        m = _TYPE.fullmatch(text.strip())
        if not m:
            raise ValueError(f"not a feedback type expression: {text!r}")
        kind, op, value = m.groups()
        if op == "=":
            if not allow_equals:
                raise ValueError(f"{text!r}: '=' compares nothing; name the type alone")
            op = None
        return cls(kind.strip(), op or "", float(value) if op else 0.0)

    def column(self, kind: str = "feedback_type", value: str = "value") -> Column:
        """Type equality and the comparison (PR2); null values fail comparisons."""
        same = F.col(kind) == self.feedback_type
        return same & _OPS[self.op](F.col(value), self.value) if self.op else same


def matches(expressions: list[str], kind: str = "feedback_type", value: str = "value") -> Column:
    """Whether any expression matches; an empty list matches nothing (PR3)."""
    return reduce(operator.or_, [TypeExpression.parse(e).column(kind, value) for e in expressions], F.lit(False))


def matches_or_all(expressions: list[str] | None) -> Column:
    """As a scan predicate: no list is no filter (PR4)."""
    return matches(expressions) if expressions else F.lit(True)


def has_all(categories: Column, wanted: list[str]) -> Column:
    """Whether all of ``wanted`` are among the categories (PR5); null categories have none."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), F.coalesce(categories, F.array().cast("array<string>")))) == 0


def has_any(categories: Column, wanted: list[str]) -> Column:
    """Whether any of ``wanted`` is among the categories; no wish is no filter (VE3)."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, wanted))), F.lit(False))


def visible(hidden: Column | None = None) -> Column:
    """Not hidden; a null flag is not hidden (PR6)."""
    return ~F.coalesce(F.col("is_hidden") if hidden is None else hidden, F.lit(False))


def days_before(as_of: str, days: float) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"make_dt_interval({int(days)}, 0, 0, {(days - int(days)) * 86400:.6f})")


def fresh(time: Column, as_of: str, days: float, strict: bool = False) -> Column:
    """Not older than ``days`` before ``as_of``: inclusive when loading, strict when serving (PR7); 0 is no limit."""
    if not days:
        return F.lit(True)
    return time > days_before(as_of, days) if strict else time >= days_before(as_of, days)


def known_by(time: Column, as_of: str, tolerance_s: float = 0) -> Column:
    """Not dated after ``as_of`` plus the clocks' tolerance (PR8, ST3, ST4)."""
    limit = F.lit(as_of).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, 0, {tolerance_s:.6f})") if tolerance_s else F.lit(as_of).cast("timestamp_ntz")
    return time <= limit
