"""Drilling across: results of several queries merged on their common columns.

Columns that a side lacks count as totals there. Rows meet where all columns, so padded, are equal: a
full outer join on null-safe keys. A left merge then drops right-only rows whose common columns the left
side doesn't have, an inner merge also left rows whose common columns the right side doesn't have.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..plans import model as M
from . import ordering


@dataclass
class Flat:
    """A result by output names: ``v.<name>`` values, ``t.<name>`` total flags, ``m.<name>`` measures."""

    frame: DataFrame
    dims: dict[str, DataType]
    measures: list[str]


def flat(c) -> Flat:
    out = c.outputs()
    rows = c.frame(c.scope)
    measures = {m.alias for m in c.query.measures}
    columns, dims = [], {}
    for name, column in out:
        if name in measures:
            columns.append(F.col(column).alias(f"m.{name}"))
        elif name not in dims:
            dims[name] = rows.schema[column].dataType
            columns += [F.col(column).alias(f"v.{name}"), (F.col(f"g{column[1:]}") if column != "cs" else F.lit(0)).alias(f"t.{name}")]
    return Flat(rows.select(*columns), dims, [n for n, _ in out if n in measures])


def _padded(side: Flat, dims: dict[str, DataType], prefix: str) -> DataFrame:
    missing = {n: t for n, t in dims.items() if n not in side.dims}
    rows = side.frame.withColumns({f"v.{n}": F.lit(None).cast(t) for n, t in missing.items()} | {f"t.{n}": F.lit(1) for n in missing}) if missing else side.frame
    keys = [F.col(f"`{k}.{n}`").alias(f"{prefix}{k}.{n}") for n in dims for k in "vt"]
    return rows.select(*keys, *[F.col(f"`m.{n}`") for n in side.measures], F.lit(True).alias(f"{prefix}here"))


def merged(left: Flat, right: Flat, how: str) -> Flat:
    if shared := set(left.measures) & set(right.measures):
        raise ValueError(f"both sides have the measures {sorted(shared)}")
    common = [n for n in left.dims if n in right.dims]
    for n in common:
        if left.dims[n] != right.dims[n]:
            raise ValueError(f"{n} has the types {left.dims[n].simpleString()} and {right.dims[n].simpleString()}")
    dims = left.dims | {n: t for n, t in right.dims.items() if n not in left.dims}
    a, b = _padded(left, dims, "l"), _padded(right, dims, "r")
    same = lambda names, x, y: reduce(and_, [F.col(f"`{x}v.{n}`").eqNullSafe(F.col(f"`{y}v.{n}`")) & (F.col(f"`{x}t.{n}`") == F.col(f"`{y}t.{n}`")) for n in names], F.lit(True))
    both = a.join(b, same(dims, "l", "r"), "full") if dims else a.crossJoin(b)
    if how in ("left", "inner"):
        pick = lambda rows, x, y: rows.select(*[F.col(f"`{x}{k}.{n}`").alias(f"{y}{k}.{n}") for n in common for k in "vt"], F.lit(True).alias(f"{y}in")).distinct()
        both = both.join(pick(a, "l", "a"), same(common, "r", "a"), "left")
        keep = F.col("lhere").isNotNull() | F.col("ain").isNotNull()
        if how == "inner":
            both = both.join(pick(b, "r", "b"), same(common, "l", "b"), "left")
            keep = F.when(F.col("lhere").isNotNull(), F.col("bin").isNotNull()).otherwise(F.col("ain").isNotNull())
        both = both.where(keep)
    elif how not in ("full", "cross"):
        raise ValueError(f"unknown merge {how}")
    keys = [F.coalesce(F.col(f"`l{k}.{n}`"), F.col(f"`r{k}.{n}`")).alias(f"{k}.{n}") for n in dims for k in "vt"]
    measures = [*left.measures, *right.measures]
    return Flat(both.select(*keys, *[F.col(f"`m.{n}`") for n in measures]), dims, measures)


def labelled(side: Flat, axes: list[list[str]] | None = None) -> list:
    """Output columns; totals as text. With axes, each has its own grand total."""
    out = []
    for n in side.dims:
        axis = next((x for x in axes if n in x), list(side.dims)) if axes else list(side.dims)
        every = reduce(and_, [F.col(f"`t.{x}`") == 1 for x in axis if x in side.dims])
        total = F.when(every, F.lit(M.GRAND_TOTAL)).when(F.col(f"`t.{n}`") == 1, F.lit(M.TOTAL))
        out.append(total.otherwise(F.col(f"`v.{n}`").cast("string")).alias(n))
    return out + [F.col(f"`m.{n}`").alias(n) for n in side.measures]


def sort_keys(side: Flat, queries: list[M.Query]) -> list:
    """Earlier queries' orders win; a column set's declared order holds for its columns, others last."""
    orders: dict[str, object] = {}
    for q in queries:
        for f, order in q.orders:
            orders.setdefault(M.output_name(f), order)
    out, done = [], set()
    column = lambda n: (F.col(f"`v.{n}`"), F.col(f"`t.{n}`")) if n in side.dims else (F.col(f"`m.{n}`"), None)
    for n, order in orders.items():
        if n in side.dims or n in side.measures:
            out += ordering.order_keys(order, *column(n))
            done.add(n)
    for q in queries:
        own = q.column_set
        if own is not None and own.new_field in side.dims and own.new_field not in done:
            group, value = column(own.new_field)[0], column(M.output_name(own.field))[0]
            rank, inner = F.lit(len(own.groups)), F.lit(0)
            for g, (name, values) in reversed(list(enumerate(own.groups))):
                rank = F.when(group.eqNullSafe(F.lit(name)), F.lit(g)).otherwise(rank)
                inner = F.when(group.eqNullSafe(F.lit(name)), ordering._explicit(value, values)).otherwise(inner)
            out += [rank.asc(), inner.asc()]
            done |= {own.new_field, M.output_name(own.field)}
    for n in [*side.dims, *side.measures]:
        if n not in done:
            value, total = column(n)
            out += ordering.order_keys(M.SimpleOrder(nulls_last=True), value, total)
    return out
