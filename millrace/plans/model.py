"""The query model: an immutable description of one single-table SELECT, shared by SQL and code.

Conditions are trees of And, Or, Not and the leaves Compare, In and Between. Operands are columns or,
in HAVING and ORDER BY, aggregates. Literals keep their text until they meet a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Union

FUNCTIONS = ("count", "sum", "min", "max", "avg")


class QueryError(ValueError):
    """A query that this engine does not answer."""


@dataclass(frozen=True)
class Col:
    name: str

    @property
    def label(self) -> str:
        return self.name


@dataclass(frozen=True)
class Agg:
    function: str
    column: str = "*"

    def __post_init__(self):
        object.__setattr__(self, "function", self.function.lower())
        if self.function not in FUNCTIONS:
            raise QueryError(f"unknown aggregate {self.function}; there are {', '.join(FUNCTIONS)}")
        if self.column == "*" and self.function != "count":
            raise QueryError(f"{self.function}(*) has no meaning")

    @property
    def label(self) -> str:
        return f"{self.function}({self.column})"


@dataclass(frozen=True)
class Lit:
    """A literal as written; text is set for quoted ones."""

    raw: str
    text: bool = False

    @staticmethod
    def of(value) -> Lit:
        return value if isinstance(value, Lit) else Lit(str(value), isinstance(value, str))


Operand = Union[Col, Agg]


@dataclass(frozen=True)
class Compare:
    left: Operand
    op: str
    right: Lit


@dataclass(frozen=True)
class In:
    left: Operand
    values: tuple[Lit, ...]


@dataclass(frozen=True)
class Between:
    left: Operand
    low: Lit
    high: Lit


@dataclass(frozen=True)
class And:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Not:
    part: Condition


Condition = Union[Compare, In, Between, And, Or, Not]


@dataclass(frozen=True)
class Item:
    """One entry of the select list; value None is a star."""

    value: Operand | None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.value.label


@dataclass(frozen=True)
class Order:
    value: Operand
    descending: bool = False


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...] = (Item(None),)
    table: str | None = None
    filter: Condition | None = None
    group: tuple[str, ...] = ()
    having: Condition | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False

    @property
    def aggregates(self) -> bool:
        return any(isinstance(i.value, Agg) for i in self.items)


@dataclass(frozen=True)
class Builder:
    """Query in code: Builder().select("country", count()).where(col("clicks") > 2).build()."""

    query: Query = field(default_factory=Query)

    def _with(self, **changes) -> Builder:
        return Builder(replace(self.query, **changes))

    def select(self, *items: str | Operand | Item) -> Builder:
        return self._with(items=tuple(i if isinstance(i, Item) else Item(None if i == "*" else Col(i) if isinstance(i, str) else i) for i in items))

    def where(self, condition: Condition) -> Builder:
        return self._with(filter=condition)

    def group_by(self, *columns: str) -> Builder:
        return self._with(group=columns)

    def having(self, condition: Condition) -> Builder:
        return self._with(having=condition)

    def order_by(self, *keys: str | Operand | Order) -> Builder:
        return self._with(order=tuple(k if isinstance(k, Order) else Order(Col(k) if isinstance(k, str) else k) for k in keys))

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def offset(self, n: int) -> Builder:
        return self._with(offset=n)

    def build(self) -> Query:
        return self.query
