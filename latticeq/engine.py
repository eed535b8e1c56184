"""The façade: queries, pivots, merges and joins of queries over a catalog."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import FrameCache
from .operators import merge, ordering, pivot, queryjoin
from .plans import describe
from .plans import model as M
from .plans.compiler import Compiler
from .sources import render
from .sources.catalog import Catalog

AGGREGATE_FUNCTIONS = ["any_value", "avg", "corr", "count", "count_if", "covar_pop", "covar_samp", "listagg", "max", "median", "min", "mode", "stddev_pop", "stddev_samp", "sum", "var_pop", "var_samp", "variance"]


class LimitExceeded(Exception):
    """A result that has to be whole reached the limit."""


@dataclass
class Result:
    """``frame``: rows by output name. ``raw``: the same rows before labels, with a total flag each (t0, t1...)."""

    frame: DataFrame
    raw: DataFrame
    names: list[str]
    measures: list[str]
    minify: bool | None = None
    axes: tuple[list[str], list[str]] | None = None
    hidden: list[str] | None = None
    debug: dict[str, Any] | None = None
    limit: int | None = None
    on_limit: Callable[[int], None] | None = None

    def _collected(self, frame: DataFrame) -> list[tuple]:
        """All rows; tells ``on_limit`` where there are as many as the limit allows."""
        found = [tuple(r) for r in frame.collect()]
        if self.limit and self.on_limit and len(found) >= self.limit:
            self.on_limit(self.limit)
        return found

    def rows(self) -> list[tuple]:
        return self._collected(self.frame)

    def write(self, path: str, kind: str = "parquet", mode: str = "error", **options: Any) -> None:
        """The labelled rows as files of any kind that Spark writes; a pivot table's as flat rows."""
        self.frame.write.format(kind).mode(mode).options(**options).save(path)

    def csv(self) -> str:
        grid = self.matrix() if self.axes else [self.names, *self.rows()]
        return render.csv(grid[0], grid[1:])

    def text(self) -> str:
        grid = self.matrix() if self.axes else [self.names, *self.rows()]
        return render.text([x if x is not None else "" for x in grid[0]], grid[1:])

    def cells(self) -> list[dict[str, Any]]:
        n = len(self.names)
        rows = self._collected(self.raw)
        values, totals = [r[:n] for r in rows], [[x == 1 for x in r[n:]] for r in rows]
        if not self.axes:
            return render.cells(self.names, self.measures, values, totals, self.minify)
        out = render.cells(self.names, self.measures, values, totals, False)
        if self.minify is False:
            return out
        full = [dict(zip(self.names, r, strict=True)) | {"\0": tuple((x, t) for x, t, c in zip(r, f, self.names, strict=True) if c in self.axes[1])} for r, f in zip(values, totals, strict=True)]
        alive = {(r["\0"], m) for r in full for m in self.measures if r[m] is not None}
        return [{k: v for k, v in cell.items() if k not in self.measures or (r["\0"], k) in alive} for cell, r in zip(out, full, strict=True)]

    def matrix(self) -> list[list[Any]]:
        rows = [dict(zip(self.names, r, strict=True)) for r in self.rows()]
        grid = pivot.matrix(rows, *self.axes, self.measures)
        if self.minify is False or not rows:
            return grid
        alive = {(tuple(r[n] for n in self.axes[1]), m) for r in rows for m in self.measures if r[m] is not None}
        across = list(dict.fromkeys(tuple(r[n] for n in self.axes[1]) for r in rows))
        lead = len(self.axes[0])
        keep = list(range(lead)) + [lead + i for i, (c, m) in enumerate((c, m) for c in across for m in self.measures) if (c, m) in alive]
        return [[r[i] for i in keep] for r in grid]

    def json(self) -> dict[str, Any]:
        if self.axes:
            return {"cells": self.cells(), "rows": self.axes[0], "columns": self.axes[1], "values": self.measures, "hiddenTotals": self.hidden or []}
        types = dict(self.raw.dtypes)
        metadata = [{"name": n, "type": types.get(f"c{i}", "string"), "isMeasure": n in self.measures} for i, n in enumerate(self.names)]
        return {"columns": self.names, "cells": self.cells(), "metadata": metadata, "debug": self.debug or {}}


class Engine:
    """``limit`` rows are given of any result whose query doesn't say (None: all).

    ``on_limit`` is called with the limit when the rows of a result reach it, so may lack some.
    """

    def __init__(self, spark: SparkSession, limit: int | None = 10_000, cache: FrameCache | None = None, on_limit: Callable[[int], None] | None = None):
        self.spark, self.limit, self.cache, self.on_limit = spark, limit, cache, on_limit
        self.catalog = Catalog(spark)

    def _compiler(self, q: M.Query, axes=None, user: str = "") -> Compiler:
        action = dict(q.parameters).get("cache", "USE")
        return Compiler(self.catalog, q, axes, self.cache.lookup(user, action) if self.cache is not None else None)

    def _result(self, c: Compiler, axes: tuple[list[str], list[str]] | None = None, minify: bool | None = None, hidden: Sequence[M.Field] = ()) -> Result:
        out = c.outputs()
        rows = c.frame(c.scope).orderBy(*ordering.keys(c, out))
        limit = c.query.limit if c.query.limit > 0 else self.limit
        rows = rows.limit(limit) if limit else rows
        names = [n for n, _ in out]
        flag = lambda x: F.col(f"g{x[1:]}") if x[0] == "d" and x[1:].isdigit() else F.lit(0)
        raw = rows.select(*[F.col(x).alias(f"c{i}") for i, (_, x) in enumerate(out)], *[flag(x).alias(f"t{i}") for i, (_, x) in enumerate(out)])
        if axes is None:
            shown = [c.labelled(x, bool(c.query.rollup)).alias(f"c{i}") for i, (_, x) in enumerate(out)]
        else:
            columns = dict(out)
            shown = []
            for i, (n, x) in enumerate(out):
                if not x.startswith("d"):
                    shown.append(F.col(x).alias(f"c{i}"))
                    continue
                own = [columns[a] for axis in axes if n in axis for a in axis]
                every = reduce(and_, [flag(a) == 1 for a in own], F.lit(True))
                shown.append(F.when(every, F.lit(M.GRAND_TOTAL)).when(flag(x) == 1, F.lit(M.TOTAL)).otherwise(F.col(x).cast("string")).alias(f"c{i}"))
        frame = rows.select(*shown).toDF(*names)
        measures = [m.alias for m in c.query.measures]
        return Result(frame, raw, names, measures, minify if minify is not None else c.query.minify, axes, [M.output_name(f) for f in hidden], {"cache": self.cache.stats()} if self.cache else {}, limit, self.on_limit)

    def query(self, q: M.Query, user: str = "", strict_limit: bool = False) -> Result:
        """A tabular result. With ``strict_limit`` a result of the limit's size raises LimitExceeded."""
        c = self._compiler(q, user=user)
        out = self._result(c)
        if strict_limit:
            self._within(c.frame(c.scope), q)
        return out

    def _within(self, frame: DataFrame, q: M.Query) -> None:
        limit = q.limit if q.limit > 0 else self.limit
        if limit and frame.limit(limit).count() >= limit:
            raise LimitExceeded(f"query limit exceeded: {limit}")

    def frame(self, q: M.Query) -> DataFrame:
        """The rows of a query, lazily; labelled, without order and limit unless the query has one."""
        c = self._compiler(q)
        return c.result(order=q.limit > 0, limited=q.limit > 0)

    def explain(self, q: M.Query) -> str:
        """The scopes that a query is made of: filters, grains and base measures."""
        return describe.scopes(self._compiler(q))

    def pivot(self, p: M.PivotQuery, user: str = "", strict_limit: bool = False) -> Result:
        """A pivot table. With ``strict_limit`` a merged query's part of the limit's size raises LimitExceeded."""
        if isinstance(p.query, M.MergeQuery):
            return self._merge_pivot(p, user, strict_limit)
        q, axes = pivot.prepared(p.query, list(p.rows), list(p.columns), list(p.hidden_totals))
        c = self._compiler(q, axes, user)
        return self._result(c, ([M.output_name(f) for f in p.rows], [M.output_name(f) for f in p.columns]), p.minify, p.hidden_totals)

    def _merged(self, m: M.MergeQuery, compilers: list[Compiler], strict_limit: bool) -> merge.Flat:
        if strict_limit:
            for c in compilers:
                self._within(c.frame(c.scope), c.query)
        sides = [merge.flat(c) for c in compilers]
        out = sides[0]
        for how, side in zip(m.joins, sides[1:], strict=True):
            out = merge.merged(out, side, how)
        return out

    def _merge_result(self, side: merge.Flat, m: M.MergeQuery, axes=None, minify=None, hidden=()) -> Result:
        rows = side.frame.orderBy(*merge.sort_keys(side, list(m.queries)))
        names = [*side.dims, *side.measures]
        raw = rows.select(*[F.col(f"`v.{n}`").alias(f"c{i}") for i, n in enumerate(side.dims)], *[F.col(f"`m.{n}`").alias(f"c{len(side.dims) + i}") for i, n in enumerate(side.measures)], *[F.col(f"`t.{n}`").alias(f"t{i}") for i, n in enumerate(side.dims)], *[F.lit(0).alias(f"t{len(side.dims) + i}") for i in range(len(side.measures))])
        return Result(rows.select(*merge.labelled(side, axes)), raw, names, side.measures, minify, axes, list(hidden))

    def merge(self, m: M.MergeQuery, user: str = "", strict_limit: bool = False) -> Result:
        side = self._merged(m, [self._compiler(q, user=user) for q in m.queries], strict_limit)
        return self._merge_result(side, m, minify=m.minify)

    def _merge_pivot(self, p: M.PivotQuery, user: str, strict_limit: bool) -> Result:
        compilers = []
        for q in p.query.queries:
            own = {M.output_name(f) for f in q.columns} | ({q.column_set.new_field, M.output_name(q.column_set.field)} if q.column_set else set())
            local = lambda axis, own=own: [f for f in axis if M.output_name(f) in own]
            ready, axes = pivot.prepared(q, local(p.rows), local(p.columns), local(p.hidden_totals))
            compilers.append(self._compiler(ready, axes, user))
        axes = [M.output_name(f) for f in p.rows], [M.output_name(f) for f in p.columns]
        return self._merge_result(self._merged(p.query, compilers, strict_limit), p.query, axes, p.minify, [M.output_name(f) for f in p.hidden_totals])

    def join(self, q: M.JoinQuery) -> DataFrame:
        plain = lambda x: self._compiler(replace(x, limit=-1)).result(order=False, limited=False, labels=False)
        return queryjoin.joined(plain, q, self.limit)

    def sql(self, text: str) -> DataFrame:
        """Raw SQL over the catalog's tables; those whose names stand in ``text`` become views of this session."""
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for name in self.catalog.frames:
            if words.issuperset(re.findall(r"\w+", name.lower())):
                self.catalog.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def metadata(self) -> dict[str, Any]:
        stores = [{"name": n, "fields": [{"expression": f"{n}.{f.name}", "name": f.name, "type": f.dataType.simpleString()} for f in s]} for n, s in self.catalog.stores().items()]
        return {"stores": stores, "aggregationFunctions": AGGREGATE_FUNCTIONS, "measures": []}
