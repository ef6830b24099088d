"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import NotAnExpressionKindError


@dataclass(frozen=True)
class Expression:
    """A field or a constant."""

    value: int | str
    is_field: bool = False

    @property
    def is_constant(self) -> bool:
        return not self.is_field

    def as_constant(self) -> int | str:
        if self.is_field:
            raise NotAnExpressionKindError(f"{self} is a field")
        return self.value

    def as_field(self) -> str:
        if not self.is_field:
            raise NotAnExpressionKindError(f"{self} is a constant")
        return str(self.value)

    def applies_to(self, fields: set[str]) -> bool:
        return not self.is_field or self.value in fields

    def __str__(self) -> str:
        if self.is_field or isinstance(self.value, int):
            return str(self.value)
        return "'" + self.value.replace("'", "''") + "'"


def column(name: str) -> Expression:
    return Expression(name, True)


def constant(value: int | str) -> Expression:
    return Expression(value)


@dataclass(frozen=True)
class Term:
    """An equality."""

    lhs: Expression
    rhs: Expression

    def __str__(self) -> str:
        return f"{self.lhs} = {self.rhs}"


@dataclass(frozen=True)
class Query:
    fields: tuple[str, ...]
    tables: tuple[str, ...]
    where: tuple[Term, ...] = ()

    def __str__(self) -> str:
        return f"select {', '.join(self.fields)} from {', '.join(self.tables)}" + (f" where {' and '.join(map(str, self.where))}" if self.where else "")


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[int | str, ...]


@dataclass(frozen=True)
class Update:
    table: str
    field: str
    value: Expression
    where: tuple[Term, ...] = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Term, ...] = ()


@dataclass(frozen=True)
class FieldDef:
    """``length`` is the number of characters of a varchar, None for an int."""

    name: str
    length: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    fields: tuple[FieldDef, ...]


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Query
    text: str = field(compare=False, default="")


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    field: str


Statement = Query | Insert | Update | Delete | CreateTable | CreateView | CreateIndex
