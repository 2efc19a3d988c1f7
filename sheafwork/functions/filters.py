"""Typed predicates on records: a closed language, translated into Catalyst expressions.

Nothing is filtered outside the plan: a construct that isn't known raises, so that whatever
is accepted can be pushed down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Predicate:
    """A predicate; ``&``, ``|`` and ``~`` combine them."""

    def __and__(self, other: Predicate) -> Predicate:
        return _Many("and", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return _Many("or", (self, other))

    def __invert__(self) -> Predicate:
        return _Not(self)

    def column(self, schema: T.StructType) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class _Many(Predicate):
    how: str
    parts: tuple[Predicate, ...]

    def column(self, schema: T.StructType) -> Column:
        return reduce((lambda a, b: a & b) if self.how == "and" else (lambda a, b: a | b), [p.column(schema) for p in self.parts])


@dataclass(frozen=True)
class _Not(Predicate):
    of: Predicate

    def column(self, schema: T.StructType) -> Column:
        # what is unknown counts as false before it is negated, so rows with nulls are kept
        return ~F.coalesce(self.of.column(schema), F.lit(False))


@dataclass(frozen=True)
class _Test(Predicate):
    name: str
    how: str
    value: Any = None

    def column(self, schema: T.StructType) -> Column:
        if self.name not in schema.names:
            raise SheafError(5211, f"no column {self.name!r}")
        field, c, v = schema[self.name], F.col(f"`{self.name}`"), self.value
        if self.how in ("eq", "ne") and v is None:
            return c.isNull() if self.how == "eq" else c.isNotNull()
        if self.how == "eq":
            return c == _literal(v, field)
        if self.how == "ne":
            return ~c.eqNullSafe(_literal(v, field)) if field.nullable else c != _literal(v, field)
        if self.how in ("lt", "le", "gt", "ge"):
            x = _literal(v, field)
            return {"lt": c < x, "le": c <= x, "gt": c > x, "ge": c >= x}[self.how]
        if self.how == "in":
            known = [x for x in v if x is not None]
            return c.isin(*[_literal(x, field) for x in known]) if known else F.lit(False)
        if self.how == "true":
            if not isinstance(field.dataType, T.BooleanType):
                raise SheafError(5211, f"{self.name!r} is no truth value")
            return c
        if not isinstance(field.dataType, T.StringType):
            raise SheafError(5211, f"{self.name!r} is no text")
        # letters of ASCII compare without case, all others as they are
        fold = F.translate(c, _UPPER, _LOWER)
        text = F.lit("".join(_LOWER[_UPPER.index(ch)] if ch in _UPPER else ch for ch in v))
        return {"starts": fold.startswith, "ends": fold.endswith, "contains": fold.contains}[self.how](text)


def _literal(v: Any, field: T.StructField) -> Column:
    """A constant of the column's type; a float compares as the double that the column holds."""
    return F.lit(v).cast(T.FloatType()).cast(T.DoubleType()) if isinstance(field.dataType, T.FloatType) else F.lit(v)


@dataclass(frozen=True)
class Field:
    """A column in a predicate: ``Field("n") > 3``, ``Field("t").starts("a")``."""

    name: str

    def __eq__(self, v: Any) -> Predicate:  # type: ignore[override]
        return _Test(self.name, "eq", v)

    def __ne__(self, v: Any) -> Predicate:  # type: ignore[override]
        return _Test(self.name, "ne", v)

    def __lt__(self, v: Any) -> Predicate:
        return _Test(self.name, "lt", v)

    def __le__(self, v: Any) -> Predicate:
        return _Test(self.name, "le", v)

    def __gt__(self, v: Any) -> Predicate:
        return _Test(self.name, "gt", v)

    def __ge__(self, v: Any) -> Predicate:
        return _Test(self.name, "ge", v)

    def isin(self, *values: Any) -> Predicate:
        return _Test(self.name, "in", values)

    def starts(self, text: str) -> Predicate:
        return _Test(self.name, "starts", text)

    def ends(self, text: str) -> Predicate:
        return _Test(self.name, "ends", text)

    def contains(self, text: str) -> Predicate:
        return _Test(self.name, "contains", text)

    def true(self) -> Predicate:
        return _Test(self.name, "true")


def where(df, predicate: Predicate | None):  # noqa: ANN001, ANN201
    """``df`` with the predicate applied; none keeps all rows."""
    if predicate is None:
        return df
    if not isinstance(predicate, Predicate):
        raise SheafError(5211, f"{type(predicate).__name__} is no predicate")
    return df.where(predicate.column(df.schema))
