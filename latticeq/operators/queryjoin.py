"""Queries joined as tables: each is aggregated on its own, then joined from left to right."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import model as M
from . import criteria, ordering


def joined(compile_, q: M.JoinQuery, default_limit: int | None) -> DataFrame:
    """``compile_`` gives a query's unordered, unlimited result. Without any limit all rows are given.

    Without a condition two sides join null-safe on the names they share, and cross where they share none.
    All queries' columns come first, then all measures. Names that an earlier query has are dropped from
    later ones, as are columns of a later query that its condition compares with another field.
    """
    known: list[tuple[str, str, str | None]] = []  # output name, internal column, its query's table
    shown: dict[str, str] = {}
    values: dict[str, str] = {}
    compared: set[str] = set()
    rows: DataFrame | None = None

    def column(f: M.Field) -> Column:
        if isinstance(f, M.ConstantField):
            return F.lit(f.value)
        if (found := _find(f, known)) is None:
            raise ValueError(f"{M.output_name(f)} is in none of the joined queries")
        return F.col(found)

    for i, (query, how, on) in enumerate([(q.first, "", None), *q.others]):
        frame = compile_(query)
        names = frame.columns
        own = [(n, f"q{i}_{j}", query.table.name) for j, n in enumerate(names)]
        frame = frame.toDF(*[c for _, c, _ in own])
        if rows is None:
            rows = frame
        elif on is not None:
            # A bare name in a condition means the earlier side first; qualified names find their table.
            side = lambda f, before=list(known), own=own: _side(f, before, own)
            rows = rows.join(frame, criteria.predicate(on, lambda f, side=side: F.lit(f.value) if isinstance(f, M.ConstantField) else F.col(side(f))), how)
            mine = {c for _, c, _ in own}
            compared |= {side(f) for f in _compared(on)} & mine
        else:
            shared = [(c, shown[n]) for n, c, _ in own if n in shown]
            rows = rows.join(frame, reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in shared]), how) if shared else rows.crossJoin(frame)
        known += own
        measures = {m.alias for m in query.measures}
        for n, c, _ in own:
            (values if n in measures else shown).setdefault(n, c)
    if (where := criteria.predicate(q.where, column)) is not None:
        rows = rows.where(where)
    if q.orders:
        rows = rows.orderBy(*[k for f, order in q.orders for k in ordering.order_keys(order, column(f), None)])
    if limit := q.limit if q.limit > 0 else default_limit:
        rows = rows.limit(limit)
    out = [(n, c) for n, c in shown.items() if c not in compared] + list(values.items())
    return rows.select(*[F.col(c) for _, c in out]).toDF(*[n for n, _ in out])


def _compared(tree: M.Criteria) -> list[M.Field]:
    """Fields that stand in comparisons of two fields."""
    if isinstance(tree, M.Tree):
        return [f for c in tree.children for f in _compared(c)]
    return [f for f in (tree.left, tree.right) if not isinstance(f, M.ConstantField)] if isinstance(tree, M.FieldPair) else []


def _find(f: M.Field, part: list[tuple[str, str, str | None]]) -> str | None:
    name = M.output_name(f.as_(None))
    for n, column, table in part:
        if n in (name, f.alias) or (isinstance(f, M.TableField) and f.table in (None, table) and n.rpartition(".")[2] == f.column):
            return column
    return None


def _side(f: M.Field, before: list, own: list) -> str:
    table = f.table if isinstance(f, M.TableField) else None
    order = [own, before] if table is not None and any(t == table for _, _, t in own) else [before, own]
    for part in order:
        if (found := _find(f, part)) is not None:
            return found
    raise ValueError(f"{M.output_name(f)} is in none of the joined queries")
