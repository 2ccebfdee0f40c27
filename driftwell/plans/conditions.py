"""Conditions of repair rules over the values of both sides, as data, compiled to a Column.

A condition is what a plan file holds, one key a level:

    {"all": [condition, ...]}      {"any": [condition, ...]}      {"not": condition}
    {"null": operand}              {"in": [operand, [operand, ...]]}
    {"=": [operand, operand]}      and != < <= > >=

and an operand is ``{"n1": column}``, ``{"n2": column}``, or a value: text, number, true, false or null. There is no text form of
it: what is not data can be said in Spark SQL (``Rule.when``), with the NULL rules of SQL.

NULL equals NULL and differs from everything else; to order it is an error, which stops the plan. A column that the
table lacks, and all columns of a side that lacks the row, are NULL. Numbers compare exactly across types, a double by the
decimal that it prints as; texts compare by their bytes; booleans have no order; a date or timestamp compares with others and
with texts that can be read as one. Other mixtures are refused when the condition is compiled. ``all`` and ``any`` stop at the
first condition that decides, so what stands behind it cannot fail.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: By operator, whether it holds for an order of -1, 0 or 1 (fixed values).
COMPARISONS: dict[str, tuple[int, ...]] = {"=": (0,), "!=": (-1, 1), "<": (-1,), "<=": (-1, 0), ">": (1,), ">=": (0, 1)}
NULL, NUMBER, TEXT, TRUTH, TIME = "null", "number", "text", "boolean", "time"


@dataclass(frozen=True)
class Operand:
    value: Column
    kind: str
    type: T.DataType


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(t, T.BooleanType):
        return TRUTH
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    return NULL if isinstance(t, T.NullType) else t.simpleString()


def _literal(value: object) -> Operand:
    if value is None:
        return Operand(F.lit(None), NULL, T.NullType())
    if isinstance(value, bool):
        return Operand(F.lit(value), TRUTH, T.BooleanType())
    if isinstance(value, (int, float, Decimal)):
        exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
        if not exact.is_finite():
            raise ValueError(f"{value!r} is not a number")
        text = format(exact, "f")
        whole, _, part = text.lstrip("-").partition(".")
        if len(whole) + len(part) > 38:
            raise ValueError(f"{value!r} has more than 38 digits")
        kind = T.DecimalType(len(whole) + len(part), len(part))
        return Operand(F.lit(text).cast(kind), NUMBER, kind)
    if isinstance(value, str):
        return Operand(F.lit(value), TEXT, T.StringType())
    raise ValueError(f"not a value: {value!r}")


class Compiler:
    """Compiles conditions over the columns of both sides: ``columns`` gives for n1 and n2 the column of each name and its type."""

    def __init__(self, columns: Mapping[str, Mapping[str, tuple[Column, T.DataType]]]):
        self.columns = columns

    def operand(self, of: object) -> Operand:
        if not isinstance(of, Mapping):
            return _literal(of)
        if len(of) != 1 or next(iter(of)) not in self.columns:
            raise ValueError(f"not a column of n1 or n2: {of!r}")
        ((side, name),) = of.items()
        if name not in self.columns[side]:
            return _literal(None)
        column, kind = self.columns[side][name]
        return Operand(column, _kind(kind), kind)

    def condition(self, of: object) -> Column:
        if isinstance(of, bool):
            return F.lit(of)
        if not isinstance(of, Mapping) or len(of) != 1:
            raise ValueError(f"not a condition: {of!r}")
        ((op, parts),) = of.items()
        if op in ("all", "any"):
            last = F.lit(op == "all")
            steps: Callable[[Column, Column], Column] = lambda rest, c: F.when(c, rest).otherwise(False) if op == "all" else F.when(c, True).otherwise(rest)
            return reduce(steps, reversed([self.condition(p) for p in parts]), last)
        if op == "not":
            return ~self.condition(parts)
        if op == "null":
            return self.operand(parts).value.isNull()
        if op == "in":
            value, among = self.operand(parts[0]), [self.operand(p) for p in parts[1]]
            return reduce(lambda rest, o: F.when(compared("=", value, o), True).otherwise(rest), reversed(among), F.lit(False))
        if op in COMPARISONS:
            left, right = parts
            return compared(op, self.operand(left), self.operand(right))
        raise ValueError(f"unknown operator {op!r}")


def compared(op: str, a: Operand, b: Operand) -> Column:
    equality, none = op in ("=", "!="), a.value.isNull() | b.value.isNull()
    if NULL in (a.kind, b.kind) and not equality:
        raise ValueError(f"NULL has no order: {op}")
    if NULL in (a.kind, b.kind):
        both = a.value.isNull() & b.value.isNull()
        return both if op == "=" else ~both
    kinds = {a.kind, b.kind}
    if kinds == {TIME, TEXT}:
        a, b = (x if x.kind == TIME else Operand(x.value.cast(y.type), TIME, y.type) for x, y in ((a, b), (b, a)))
    elif len(kinds) > 1 or not kinds <= {NUMBER, TEXT, TRUTH, TIME}:
        raise ValueError(f"{a.kind} and {b.kind} cannot be compared")
    elif kinds == {TRUTH} and not equality:
        raise ValueError(f"booleans have no order: {op}")
    order = _number_order(a, b) if a.kind == NUMBER else _order(a.value, b.value)
    holds = reduce(Column.__or__, [order == k for k in COMPARISONS[op]])
    if equality:
        return F.when(none, (a.value.isNull() & b.value.isNull()) == F.lit(op == "=")).otherwise(holds)
    return F.when(none, F.raise_error(F.lit(f"NULL has no order: {op}")).cast("boolean")).otherwise(holds)


def _order(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def _number_order(a: Operand, b: Operand) -> Column:
    """-1, 0 or 1. Rounding to a double keeps the order, so only a double and a number that rounds to the same one are looked at
    again, by the text of the double."""
    real = [isinstance(x.type, (T.DoubleType, T.FloatType)) for x in (a, b)]
    if all(real) or not any(real):
        return _order(a.value, b.value)
    exact = [o.value.cast("string").try_cast("decimal(38,18)") if is_real else o.value for o, is_real in zip((a, b), real, strict=True)]
    x, y = a.value.cast("double"), b.value.cast("double")
    return F.when(x < y, -1).when(x > y, 1).otherwise(F.coalesce(F.when(exact[0] < exact[1], -1).when(exact[0] > exact[1], 1), F.lit(0)))
