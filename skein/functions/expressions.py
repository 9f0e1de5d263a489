"""The user expression language for scores, filters and columns, compiled to Columns (PR9 to PR11).

Grammar: numbers, strings, ``true``/``false``, ``item.X.Y`` / ``user.X.Y``, ``len(feedback)``, ``len(item.X)``,
``count(feedback, predicate over .Field)``, ``now()``, ``.Unix() .Hours() .Nanoseconds()`` on times and differences,
``! - + * / < <= > >= == != && || and or not`` and parentheses. ``feedback`` is an aggregate context: compiled
expressions that use it are aggregates over the joined feedback rows of one item.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|('[^']*'|\"[^\"]*\")|([A-Za-z_]\w*)|(&&|\|\||==|!=|<=|>=|[-+*/<>!().,]))")
FIELDS = {
    "ItemId": "item_id", "UserId": "user_id", "IsHidden": "is_hidden", "Categories": "categories", "Timestamp": "timestamp", "Labels": "labels",
    "Comment": "comment", "FeedbackType": "feedback_type", "Value": "value", "Updated": "updated",
}
UNITS = {"Unix": 1e6, "Seconds": 1e6, "Minutes": 6e7, "Hours": 3.6e9, "Nanoseconds": 1e-3, "UnixNano": 1e-3}


@dataclass
class Value:
    column: Column
    time: bool = False  # microseconds since 1970, or between two times


class Compiler:
    """``item`` columns keep their names; ``feedback`` columns have the prefix ``fb_``; a feedback row exists where ``fb_item_id`` isn't null."""

    def __init__(self, as_of: str, grouped: bool = False, prefix: str = "fb_"):
        """``grouped``: the expression is an aggregate over an item's feedback, in whose rows its own fields are the same."""
        self.as_of, self.grouped, self.prefix = as_of, grouped, prefix

    def compile(self, text: str) -> Column:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 10]!r} in {text!r}")
            kind = "nsio"[next(i for i in range(4) if m.group(i + 1) is not None)]
            self.tokens.append((kind, m.group(m.lastindex)))
            at = m.end()
        self.i = 0
        self.inner = False
        out = self._or()
        if self.i < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.i][1]!r} in {text!r}")
        return out.column

    def _peek(self) -> str | None:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else None

    def _take(self, *wanted: str) -> str | None:
        if self._peek() in wanted:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def _need(self, wanted: str) -> None:
        if not self._take(wanted):
            raise ValueError(f"{wanted!r} expected, not {self._peek()!r}")

    def _or(self) -> Value:
        left = self._and()
        while self._take("||", "or"):
            left = Value(left.column | self._and().column)
        return left

    def _and(self) -> Value:
        left = self._compare()
        while self._take("&&", "and"):
            left = Value(left.column & self._compare().column)
        return left

    def _compare(self) -> Value:
        left = self._sum()
        op = self._take("<", "<=", ">", ">=", "==", "!=")
        if not op:
            return left
        a, b = left.column, self._sum().column
        return Value({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op])

    def _sum(self) -> Value:
        left = self._product()
        while op := self._take("+", "-"):
            right = self._product()
            left = Value(left.column + right.column if op == "+" else left.column - right.column, left.time or right.time)
        return left

    def _product(self) -> Value:
        left = self._unary()
        while op := self._take("*", "/"):
            right = self._unary()
            left = Value(left.column * right.column if op == "*" else left.column / right.column)
        return left

    def _unary(self) -> Value:
        if self._take("!", "not"):
            return Value(~self._unary().column)
        if self._take("-"):
            return Value(-self._unary().column)
        return self._postfix()

    def _postfix(self) -> Value:
        value = self._primary()
        while value.time and self._peek() == ".":
            self.i += 1
            unit = self.tokens[self.i][1]
            self.i += 1
            self._need("(")
            self._need(")")
            if unit not in UNITS:
                raise ValueError(f"unknown method {unit}")
            scaled = value.column / F.lit(UNITS[unit])
            value = Value(F.floor(scaled) if unit == "Unix" else scaled)
        return value

    def _path(self, first: str | None) -> Value:
        names = [first] if first else []
        while self._peek() == "." and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1][0] == "i" and self.tokens[self.i + 1][1] not in UNITS:
            names.append(self.tokens[self.i + 1][1])
            self.i += 2
        inner = self.inner and not first
        if first in ("item", "user", "feedback"):
            inner = first == "feedback"
            names = names[1:]
        if not names:
            raise ValueError("a field is expected")
        base = (self.prefix if inner else "") + FIELDS.get(names[0], names[0])
        column = F.any_value(F.col(base)) if self.grouped and not self.inner else F.col(base)
        for n in names[1:]:
            column = column.getField(n)
        return Value(_micros(column), True) if names[-1] in ("Timestamp", "Updated") else Value(column)

    def _primary(self) -> Value:
        if self.i >= len(self.tokens):
            raise ValueError("the expression ends too early")
        kind, text = self.tokens[self.i]
        if kind == "n":
            self.i += 1
            return Value(F.lit(float(text)))
        if kind == "s":
            self.i += 1
            return Value(F.lit(text[1:-1]))
        if text == "(":
            self.i += 1
            value = self._or()
            self._need(")")
            return value
        if text == ".":
            if not self.inner:
                raise ValueError("a field without a name before it belongs inside count()")
            return self._path(None)
        if kind != "i":
            raise ValueError(f"unexpected {text!r}")
        self.i += 1
        if text in ("true", "false"):
            return Value(F.lit(text == "true"))
        if text == "now":
            self._need("(")
            self._need(")")
            return Value(_micros(F.lit(self.as_of).cast("timestamp_ntz")), True)
        if text == "len":
            self._need("(")
            if self._peek() == "feedback" and self.tokens[self.i + 1][1] == ")":
                self.i += 2
                return Value(F.count(F.col(f"{self.prefix}item_id")).cast("double"))
            value = self._or()
            self._need(")")
            return Value(F.when(value.column.isNull(), 0).otherwise(F.size(value.column)).cast("double"))
        if text == "count":
            self._need("(")
            self._need("feedback")
            self._need(",")
            self.inner = True
            test = self._or().column
            self.inner = False
            self._need(")")
            return Value(F.count_if(F.col(f"{self.prefix}item_id").isNotNull() & test).cast("double"))
        return self._path(text)


def _micros(column: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz")).cast("double")


def checked(df: DataFrame, column: Column, kind: str) -> Column:
    """``column``, if it is of the ``kind`` wanted: ``number`` for scores, ``boolean`` for filters (PR10)."""
    made = df.select(column.alias("x")).schema["x"].dataType
    fits = isinstance(made, T.NumericType) if kind == "number" else isinstance(made, T.BooleanType)
    if not fits:
        raise TypeError(f"a {kind} is wanted, not {made.simpleString()}")
    return column
