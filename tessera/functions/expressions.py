"""Expressions to Columns in two forms: value() may be null, truth() never is where it matters.

`=` and `!=` are null-safe, other comparisons and arithmetic give null for null, NOT of a null is
true. truth() leaves comparisons bare, as a filter drops nulls anyway and bare comparisons are
pushed to Parquet; only below a NOT are they completed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatchError
from ..plans import nodes as n
from .types import canonical

Resolve = Callable[[n.Name], tuple[Column, str]]
_ARITHMETIC = ("+", "-", "*", "/")
_COMPARE = ("<", "<=", ">", ">=")
_OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_NUMBERS = ("int", "float", "decimal", "bool")


def literal(x: n.Literal) -> Column:
    value = x.value
    if value is None:
        return F.lit(None)
    if x.family == "int":
        if not -(1 << 63) <= value < 1 << 63:
            raise OverflowError(f"{value} is out of range")
        return F.lit(value).cast("bigint")
    if x.family == "json":
        return F.lit(canonical(value))
    if x.family == "blob":
        return F.lit(bytearray(value))
    if x.family == "datetime":
        if value.tzinfo:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if x.family == "time":
        return F.lit(value.isoformat()).cast("time(6)")
    return F.lit(value)


class Compiler:
    def __init__(self, resolve: Resolve):
        self.resolve = resolve

    def family(self, e) -> str:
        return self.value(e)[1]

    def value(self, e) -> tuple[Column, str]:
        if isinstance(e, n.Literal):
            return literal(e), e.family
        if isinstance(e, n.Name):
            return self.resolve(e)
        if isinstance(e, n.Unary):
            if e.op == "-":
                c, f = self.value(e.operand)
                if f not in ("int", "float", "decimal"):
                    raise TypeMismatchError(f"- takes a number, not {f}")
                return -c, f
            return self.truth(e), "bool"
        if e.op in ("AND", "OR"):
            left, f = self.value(e.left)
            right, g = self.value(e.right)
            kind = f if f == g or g == "null" else g if f == "null" else None
            if kind is None:
                raise TypeMismatchError(f"{e.op} as a value takes one type, not {f} and {g}")
            decided = F.coalesce(self.truth(e.left), F.lit(False))
            return (F.when(decided, right).otherwise(left) if e.op == "AND" else F.when(decided, left).otherwise(right)), kind
        if e.op in _ARITHMETIC:
            return self.arithmetic(e)
        return self.comparison(e), "bool"

    def arithmetic(self, e) -> tuple[Column, str]:
        (a, f), (b, g) = self.value(e.left), self.value(e.right)
        if "null" in (f, g):
            return F.lit(None), "null"
        if e.op == "+" and (f, g) == ("text", "text"):
            return F.concat(a, b), "text"
        if e.op == "-" and f == g and f in ("date", "datetime"):
            return a - b, "interval"
        if f not in _NUMBERS or g not in _NUMBERS or {f, g} >= {"float", "decimal"}:
            raise TypeMismatchError(f"{e.op} does not take {f} and {g}")
        a, b = (c.cast("bigint") if k == "bool" else c for c, k in ((a, f), (b, g)))
        kind = "decimal" if "decimal" in (f, g) else "float" if "float" in (f, g) or e.op == "/" else "int"
        if e.op == "/":
            return (a / b if kind == "decimal" else a.cast("double") / b.cast("double")), kind
        return {"+": a + b, "-": a - b, "*": a * b}[e.op], kind

    def comparison(self, e) -> Column:
        (a, f), (b, g) = self.value(e.left), self.value(e.right)
        alike = f == g or f in _NUMBERS and g in _NUMBERS
        if e.op in ("=", "!="):
            if alike or "null" in (f, g):
                a, b = (c.cast("bigint") if f != g and k == "bool" else c for c, k in ((a, f), (b, g)))
                same = a.isNull() if g == "null" else b.isNull() if f == "null" else a.eqNullSafe(b)
            else:  # values of different kinds are never equal, but nulls are
                same = a.isNull() & b.isNull()
            return same if e.op == "=" else ~same
        if "null" in (f, g):
            return F.lit(None).cast("boolean")
        if not alike or f == "json":
            raise TypeMismatchError(f"{e.op} does not compare {f} and {g}")
        a, b = (c.cast("bigint") if k == "bool" else c for c, k in ((a, f), (b, g)))
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]

    def truth(self, e) -> Column:
        """A filter condition: true for the rows kept; a null is as good as false."""
        if isinstance(e, n.Binary):
            if e.op in ("AND", "OR"):
                left, right = self.truth(e.left), self.truth(e.right)
                return left & right if e.op == "AND" else left | right
            if e.op not in _ARITHMETIC:
                return self.comparison(e)
        if isinstance(e, n.Unary) and e.op != "-":
            if e.op == "NOT":
                return self.untruth(e.operand)
            c, _ = self.value(e.operand)
            return c.isNull() if e.op == "IS NULL" else c.isNotNull()
        c, f = self.value(e)
        if f == "null":
            return F.lit(False)
        if f == "bool":
            return F.coalesce(c, F.lit(False))
        if f in ("int", "float", "decimal"):
            return F.coalesce(c != 0, F.lit(False))
        if f in ("text", "blob"):
            return F.coalesce(F.length(c) > 0, F.lit(False))
        if f == "json":
            return F.coalesce(~c.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))
        return c.isNotNull()

    def untruth(self, e) -> Column:
        """NOT e, two-valued; a negated comparison becomes its opposite or a null."""
        if isinstance(e, n.Binary) and e.op in ("AND", "OR"):
            left, right = self.untruth(e.left), self.untruth(e.right)
            return left | right if e.op == "AND" else left & right
        if isinstance(e, n.Unary) and e.op == "NOT":
            return F.coalesce(self.truth(e.operand), F.lit(False))
        if isinstance(e, n.Binary) and e.op in _COMPARE:
            (a, f), (b, g) = self.value(e.left), self.value(e.right)
            if "null" in (f, g):
                return F.lit(True)
            if "float" not in (f, g):  # not-a-number has no opposite comparison
                return self.comparison(n.Binary(_OPPOSITE[e.op], e.left, e.right)) | a.isNull() | b.isNull()
        return ~F.coalesce(self.truth(e), F.lit(False))
