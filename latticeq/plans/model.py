"""Dataclasses that describe a query. All are frozen and hashable, so they serve as keys of plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

COUNT_ALIAS = "_contributors_count_"
TOTAL_COUNT_ALIAS = "_total_count_"
TOTAL, GRAND_TOTAL = "Total", "Grand Total"


def frozen(value: Any) -> Any:
    """Lists become tuples and dicts tuples of items, so that nodes stay hashable."""
    if isinstance(value, Mapping):
        return tuple((k, frozen(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(frozen(v) for v in value)
    return value


class Node:
    def __post_init__(self) -> None:
        for name, value in list(vars(self).items()):
            object.__setattr__(self, name, frozen(value))


# Fields


class Field(Node):
    alias: str | None

    def as_(self, alias: str) -> Field:
        return replace(self, alias=alias)


@dataclass(frozen=True)
class TableField(Field):
    """A column, bare or as ``table.column``."""

    name: str
    alias: str | None = None

    @property
    def table(self) -> str | None:
        return self.name.rpartition(".")[0] or None

    @property
    def column(self) -> str:
        return self.name.rpartition(".")[2]


@dataclass(frozen=True)
class AliasedField(Field):
    """A column of a sub-query or of a joined query, by its output name."""

    name: str
    alias: str | None = None


@dataclass(frozen=True)
class ConstantField(Field):
    value: Any
    alias: str | None = None


@dataclass(frozen=True)
class FunctionField(Field):
    """A function of no or one argument, by its SQL name."""

    function: str
    operand: Field | None = None
    alias: str | None = None


@dataclass(frozen=True)
class BinaryField(Field):
    op: str
    left: Field
    right: Field
    alias: str | None = None


def output_name(f: Field) -> str:
    if f.alias:
        return f.alias
    if isinstance(f, (TableField, AliasedField)):
        return f.name
    if isinstance(f, FunctionField):
        return f"{f.function}({output_name(f.operand) if f.operand else ''})"
    raise ValueError(f"{f} needs an alias to be selected")


def as_field(f: Field | str) -> Field:
    return TableField(f) if isinstance(f, str) else f


# Conditions and criteria


class Condition(Node):
    pass


@dataclass(frozen=True)
class Compare(Condition):
    """``op``: = <> < <= > >= like array_contains."""

    op: str
    value: Any


@dataclass(frozen=True)
class In(Condition):
    values: Sequence[Any]


@dataclass(frozen=True)
class Not(Condition):
    condition: Condition


@dataclass(frozen=True)
class Logical(Condition):
    op: str
    conditions: Sequence[Condition]


@dataclass(frozen=True)
class Constant(Condition):
    """``kind``: null, not_null, true, false."""

    kind: str


class Criteria(Node):
    pass


@dataclass(frozen=True)
class FieldCriterion(Criteria):
    field: Field
    condition: Condition


@dataclass(frozen=True)
class FieldPair(Criteria):
    left: Field
    right: Field
    op: str = "="


@dataclass(frozen=True)
class MeasureCriterion(Criteria):
    measure: Measure
    condition: Condition


@dataclass(frozen=True)
class Tree(Criteria):
    op: str
    children: Sequence[Criteria]


# Measures


class Measure(Node):
    alias: str


@dataclass(frozen=True)
class Aggregated(Measure):
    alias: str
    field: Field
    function: str
    distinct: bool = False
    criterion: Criteria | None = None


@dataclass(frozen=True)
class Expression(Measure):
    alias: str
    sql: str


@dataclass(frozen=True)
class Count(Measure):
    alias: str = COUNT_ALIAS


@dataclass(frozen=True)
class TotalCount(Measure):
    alias: str = TOTAL_COUNT_ALIAS


@dataclass(frozen=True)
class Binary(Measure):
    alias: str
    op: str
    left: Measure
    right: Measure


@dataclass(frozen=True)
class ConstantMeasure(Measure):
    value: int | float
    alias: str = ""

    def __post_init__(self) -> None:
        if not self.alias:
            object.__setattr__(self, "alias", f"constant({self.value})")


@dataclass(frozen=True)
class Comparison(Measure):
    """A measure against itself at another position.

    One of: ``period``; ``ancestors`` (from root to leaf; ``total`` for their grand total); else the group
    column set of the query, if ``reference`` names its fields; else the first field of ``reference``,
    ordered naturally after ``elements``.
    """

    alias: str
    method: Any
    measure: Measure
    reference: Sequence[tuple[Field, str]] = ()
    period: Period | None = None
    ancestors: Sequence[Field] | None = None
    total: bool = False
    elements: Sequence[Any] | None = None
    clear_filters: bool = True


@dataclass(frozen=True)
class GrandTotalComparison(Measure):
    alias: str
    method: str
    measure: Measure


@dataclass(frozen=True)
class AxisComparison(Measure):
    """Against the parent (or the total) along a pivot axis, ``row`` or ``column``."""

    alias: str
    method: str
    measure: Measure
    axis: str
    total: bool = False
    clear_filters: bool = True


@dataclass(frozen=True)
class Vector(Measure):
    alias: str
    field: Field
    function: str
    axis: Field


@dataclass(frozen=True)
class VectorTuple(Measure):
    """Aligned vectors of several fields; ``transform`` makes a Column from an array of structs v0, v1, ..."""

    alias: str
    parts: Sequence[tuple[Field, str]]
    axis: Field
    transform: Any = None


@dataclass(frozen=True)
class Parametrized(Measure):
    alias: str
    key: str
    parameters: Any = ()

    def get(self, name: str) -> Any:
        return dict(self.parameters).get(name)


# Periods, orders, column sets


class Period(Node):
    pass


@dataclass(frozen=True)
class Year(Period):
    year: Field
    per_year = 1

    @property
    def fields(self) -> tuple[Field, ...]:
        return (self.year,)


@dataclass(frozen=True)
class Semester(Period):
    semester: Field
    year: Field
    per_year = 2

    @property
    def fields(self) -> tuple[Field, ...]:
        return (self.semester, self.year)


@dataclass(frozen=True)
class Quarter(Period):
    quarter: Field
    year: Field
    per_year = 4

    @property
    def fields(self) -> tuple[Field, ...]:
        return (self.quarter, self.year)


@dataclass(frozen=True)
class Month(Period):
    month: Field
    year: Field
    per_year = 12

    @property
    def fields(self) -> tuple[Field, ...]:
        return (self.month, self.year)


@dataclass(frozen=True)
class SimpleOrder(Node):
    descending: bool = False
    nulls_last: bool = False


@dataclass(frozen=True)
class ExplicitOrder(Node):
    values: Sequence[Any]


@dataclass(frozen=True)
class Group(Node):
    """A column set: a new field of group names over ordered values of ``field``."""

    new_field: str
    field: Field
    groups: Sequence[tuple[str, Sequence[Any]]]


# Tables and queries


@dataclass(frozen=True)
class VirtualTable(Node):
    name: str
    fields: Sequence[str]
    records: Sequence[Sequence[Any]]


@dataclass(frozen=True)
class Join(Node):
    table: Table
    type: str = "inner"
    on: Criteria | None = None


@dataclass(frozen=True)
class Table(Node):
    """A named table, a virtual table or a sub-query, with joins in order."""

    source: Any
    joins: Sequence[Join] = ()

    @property
    def name(self) -> str | None:
        return self.source if isinstance(self.source, str) else self.source.name if isinstance(self.source, VirtualTable) else None


@dataclass(frozen=True)
class Query(Node):
    table: Table
    columns: Sequence[Field] = ()
    measures: Sequence[Measure] = ()
    column_set: Group | None = None
    where: Criteria | None = None
    having: Criteria | None = None
    rollup: Sequence[Field] = ()
    grouping_sets: Sequence[Sequence[Field]] = ()
    orders: Sequence[tuple[Field, Any]] = ()
    limit: int = -1
    minify: bool | None = None
    parameters: Any = ()


@dataclass(frozen=True)
class MergeQuery(Node):
    """Queries whose results are merged on their common columns; one join type (full, left, inner) between each two."""

    queries: Sequence[Query]
    joins: Sequence[str]
    minify: bool | None = None


@dataclass(frozen=True)
class JoinQuery(Node):
    """Queries joined as tables: (query, type, condition or None to infer it from common columns)."""

    first: Query
    others: Sequence[tuple[Query, str, Criteria | None]] = ()
    where: Criteria | None = None
    orders: Sequence[tuple[Field, Any]] = ()
    limit: int = -1


@dataclass(frozen=True)
class PivotQuery(Node):
    query: Any
    rows: Sequence[Field]
    columns: Sequence[Field]
    hidden_totals: Sequence[Field] = ()
    minify: bool | None = None


__all__ = [n for n in dir() if n[0].isupper() or n in ("as_field", "output_name", "field", "frozen")]
