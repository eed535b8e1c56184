"""A fluent builder: from_("t").join("u").on(...).where(...).select(columns, measures).rollup(...).build()."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from typing import Any

from . import model as M


def _fields(columns: Iterable[M.Field | str]) -> list[M.Field]:
    return [M.as_field(c) for c in columns]


class Builder:
    def __init__(self, table: M.Table):
        self._query = M.Query(table)
        self._open: tuple[Any, str] | None = None

    def _with(self, **changes: Any) -> Builder:
        self._close()
        self._query = replace(self._query, **changes)
        return self

    def _close(self, on: M.Criteria | None = None) -> None:
        if self._open:
            (source, kind), self._open = self._open, None
            table = source if isinstance(source, M.Table) else M.Table(source)
            joins = (*self._query.table.joins, M.Join(table, kind, on))
            self._query = replace(self._query, table=replace(self._query.table, joins=joins))

    def join(self, table: Any, kind: str = "inner") -> Builder:
        """A named, virtual or prepared table; left open for ``on``, without which it is a cross join's."""
        self._close()
        self._open = (table, kind)
        return self

    def on(self, criteria: M.Criteria) -> Builder:
        self._close(criteria)
        return self

    def where(self, criteria: M.Criteria) -> Builder:
        return self._with(where=criteria)

    def select(self, columns: Iterable[M.Field | str], measures: Iterable[M.Measure] = (), column_set: M.Group | None = None) -> Builder:
        return self._with(columns=_fields(columns), measures=list(measures), column_set=column_set)

    def rollup(self, *columns: M.Field | str) -> Builder:
        return self._with(rollup=_fields(columns))

    def having(self, criteria: M.Criteria) -> Builder:
        return self._with(having=criteria)

    def order_by(self, f: M.Field | str, descending: bool = False, nulls_last: bool = False) -> Builder:
        self._close()
        return self._with(orders=(*self._query.orders, (M.as_field(f), M.SimpleOrder(descending, nulls_last))))

    def order_by_elements(self, f: M.Field | str, values: Iterable[Any]) -> Builder:
        self._close()
        return self._with(orders=(*self._query.orders, (M.as_field(f), M.ExplicitOrder(list(values)))))

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def parameter(self, name: str, value: Any) -> Builder:
        self._close()
        return self._with(parameters=(*self._query.parameters, (name, value)))

    def minify(self, on: bool) -> Builder:
        return self._with(minify=on)

    def build(self) -> M.Query:
        self._close()
        return self._query


def from_(source: str | M.VirtualTable | M.Query | M.Table) -> Builder:
    return Builder(source if isinstance(source, M.Table) else M.Table(source))
