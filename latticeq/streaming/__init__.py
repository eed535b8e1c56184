"""Queries over unbounded tables: base aggregates of a query, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import criteria
from ..plans import model as M
from ..plans.compiler import Source, is_primitive


def continuous(catalog, q: M.Query, time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """The running result of ``q`` over a streaming table: columns, then primitive measures.

    With ``time`` and ``window`` rows are also grouped by windows of event time (column ``window``) and those
    later than ``late`` are left out. Roll-ups, orders and calculated measures need a whole result.
    """
    if q.rollup or q.grouping_sets or q.orders or q.column_set or not all(map(is_primitive, q.measures)):
        raise ValueError("a continuous query takes columns, a filter and primitive measures")
    source = Source(catalog, q.table)
    rows = source.frame.withWatermark(time, late) if time else source.frame
    if (where := criteria.predicate(q.where, source.column)) is not None:
        rows = rows.where(where)
    names = [M.output_name(f) for f in q.columns]
    rows = rows.withColumns({f"d{i}": source.column(f) for i, f in enumerate(q.columns)}) if names else rows
    keys = [F.window(time, window).alias("window")] if time and window else []
    out = rows.groupBy(*keys, *[f"d{i}" for i in range(len(names))]).agg(*[source.base(m).alias(f"m{i}") for i, m in enumerate(q.measures)])
    return out.toDF(*(["window"] if keys else []), *names, *[m.alias for m in q.measures])
