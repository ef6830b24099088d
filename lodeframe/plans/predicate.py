"""Conjunctions of equalities: as columns, split by schema, and searched for bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownNameError
from .ast import Expression, Term


def family(kind: T.DataType) -> str:
    """Values of different families are never equal; comparing them isn't an error."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return "text"
    return kind.typeName()


class Predicate:
    """An AND of terms; the empty one is true."""

    def __init__(self, terms: tuple[Term, ...] | list[Term] = ()) -> None:
        self.terms = tuple(terms)

    def __bool__(self) -> bool:
        return bool(self.terms)

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))

    def conjoin(self, other: Predicate) -> Predicate:
        return Predicate(self.terms + other.terms)

    def fields(self) -> set[str]:
        return {e.as_field() for t in self.terms for e in (t.lhs, t.rhs) if e.is_field}

    def column(self, schema: T.StructType) -> Column:
        """The condition on rows of ``schema``; unknown, where a value is null, is false."""
        return F.coalesce(self.filter(schema), F.lit(False))

    def filter(self, schema: T.StructType) -> Column:
        """As ``column``, in the bare form that reaches a scan's filters; nulls stay unknown."""
        return reduce(lambda a, b: a & b, [_equality(t, schema) for t in self.terms]) if self.terms else F.lit(True)

    def within(self, fields: set[str]) -> Predicate | None:
        """The terms on ``fields`` alone, or None."""
        return _some(t for t in self.terms if _applies(t, fields))

    def joining(self, left: set[str], right: set[str]) -> Predicate | None:
        """The terms on both schemas together that neither has alone, or None."""
        return _some(t for t in self.terms if not _applies(t, left) and not _applies(t, right) and _applies(t, left | right))

    def constant_for(self, name: str) -> int | str | None:
        """The first constant that ``name`` equals."""
        for t in self.terms:
            for a, b in ((t.lhs, t.rhs), (t.rhs, t.lhs)):
                if a.is_field and a.value == name and b.is_constant:
                    return b.as_constant()
        return None

    def field_for(self, name: str) -> str | None:
        """The first other field that ``name`` equals."""
        for t in self.terms:
            for a, b in ((t.lhs, t.rhs), (t.rhs, t.lhs)):
                if a.is_field and b.is_field and a.value == name:
                    return b.as_field()
        return None


def _some(terms) -> Predicate | None:  # noqa: ANN001
    found = tuple(terms)
    return Predicate(found) if found else None


def _applies(t: Term, fields: set[str]) -> bool:
    return t.lhs.applies_to(fields) and t.rhs.applies_to(fields)


def _typed(e: Expression, schema: T.StructType) -> tuple[Column, str]:
    if e.is_constant:
        return F.lit(e.value), "number" if isinstance(e.value, int) else "text"
    if e.value not in schema.names:
        raise UnknownNameError(f"no field {e.value}")
    return F.col(f"`{e.value}`"), family(schema[e.value].dataType)


def _equality(t: Term, schema: T.StructType) -> Column:
    (a, one), (b, other) = _typed(t.lhs, schema), _typed(t.rhs, schema)
    return a == b if one == other else F.lit(False)
