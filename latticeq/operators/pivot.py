"""Pivot tables: the grouping sets of two axes, labels by axis, and the matrix of cells."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from ..plans import model as M


def axis_fields(axis: list[M.Field], column_set: M.Group | None) -> list[M.Field]:
    """The axis without the column set's fields, which have no totals."""
    if column_set is None:
        return list(axis)
    own = {column_set.new_field, M.output_name(column_set.field)}
    return [f for f in axis if M.output_name(f) not in own]


def grouping_sets(rows: list[M.Field], columns: list[M.Field], hidden: list[M.Field]) -> list[list[M.Field]]:
    """Nothing, all beginnings of each axis, and all pairs of them, without those that give hidden totals."""
    starts = lambda axis: [tuple(axis[:i]) for i in range(1, len(axis) + 1)]
    sets = [(), *starts(rows), *starts(columns), *[(*r, *c) for r in starts(rows) for c in starts(columns)]]
    gone: set[frozenset] = set()
    for axis, other in ((rows, columns), (columns, rows)):
        for i, f in enumerate(axis):
            if f in hidden:
                gone.add(frozenset(axis[:i]))
                gone |= {frozenset((*axis[:i], *o)) for o in starts(other)}
    out: list[list[M.Field]] = []
    for s in sets:
        if frozenset(s) not in gone and list(s) not in out:
            out.append(list(s))
    return out


def prepared(q: M.Query, rows: list[M.Field], columns: list[M.Field], hidden: list[M.Field]) -> tuple[M.Query, tuple[list[M.Field], list[M.Field]]]:
    """The query with the grouping sets of the axes, and the axes for measures that refer to them."""
    if q.rollup:
        raise ValueError("a pivot table's query can't have a rollup")
    selected = {M.output_name(f) for f in q.columns} | ({q.column_set.new_field, M.output_name(q.column_set.field)} if q.column_set else set())
    axes = {M.output_name(f) for f in [*rows, *columns]}
    if axes - selected:
        raise ValueError(f"{sorted(axes - selected)} are on an axis but not selected")
    if selected - axes:
        raise ValueError(f"{sorted(selected - axes)} are selected but on no axis")
    own = axis_fields(rows, q.column_set), axis_fields(columns, q.column_set)
    return replace(q, grouping_sets=grouping_sets(*own, list(hidden))), own


def matrix(rows: list[dict[str, Any]], row_axis: list[str], column_axis: list[str], values: list[str]) -> list[list[Any]]:
    """Header rows for the column axis, a header row with the values' names, then a line for each row tuple.

    Tuples stand in order of first appearance. A row tuple without a cell has None there.
    """
    across: dict[tuple, None] = {}
    down: dict[tuple, dict[tuple, dict[str, Any]]] = {}
    for r in rows:
        c = tuple(r[n] for n in column_axis)
        across.setdefault(c)
        down.setdefault(tuple(r[n] for n in row_axis), {})[c] = r
    heads = [[n, *[None] * (len(row_axis) - 1), *[c[i] for c in across for _ in values]] for i, n in enumerate(column_axis)] if row_axis else [[c[i] for c in across for _ in values] for i, n in enumerate(column_axis)]
    heads.append([*row_axis, *[v for _ in across for v in values]])
    body = [[*key, *[cells[c][v] if c in cells else None for c in across for v in values]] for key, cells in down.items()]
    return heads + body


def minified(rows: list[dict[str, Any]], column_axis: list[str], values: list[str]) -> list[dict[str, Any]]:
    """Rows without the measures that are null wherever their column tuple stands."""
    alive = {(tuple(r[n] for n in column_axis), v) for r in rows for v in values if r[v] is not None}
    return [{k: x for k, x in r.items() if k not in values or (tuple(r[n] for n in column_axis), k) in alive} for r in rows]
