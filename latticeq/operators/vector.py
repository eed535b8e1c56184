"""Vector measures: an array per row along an axis that isn't selected, and value-at-risk over it.

Two aggregations: by dimensions and axis, then by dimensions alone into an array sorted by axis. The inner
one groups by the axis in each grouping set, so a total's vector holds the axis values' totals.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import model as M

#: Parameters of each parametrized measure, and whether they must be given.
PARAMETERS = {
    "VAR": {"value": True, "date": True, "quantile": True, "return": True},
    "INCREMENTAL_VAR": {"value": True, "date": True, "quantile": True, "ancestors": True, "axis": False},
    "OVERALL_INCREMENTAL_VAR": {"value": True, "date": True, "quantile": True, "ancestors": True, "axis": False},
}


def value_at_risk(quantile: float, what: str):
    """Of rows (axis, v0, v1): the loss, or the date, at floor(n * (1 - quantile)) in ascending order."""

    def make(rows: Column) -> Column:
        order = F.array_sort(F.transform(rows, lambda r: F.struct(r["v0"].alias("v"), r["axis"].alias("a"))))
        at = F.get(order, F.floor(F.size(order) * F.lit(1.0 - quantile)).cast("int"))
        return at["a"] if what == "date" else -at["v"]

    return make


def incremental(quantile: float):
    """The parent's value-at-risk with and without the current vector, aligned along the axis."""

    def make(current: Column, parent: Column) -> Column:
        n = F.size(parent)
        at = n - 1 if quantile == 0 else F.floor(n * F.lit(1.0 - quantile)).cast("int")
        # By axis value, not by place: a vector may lack some of its parent's axis values.
        own = F.map_from_arrays(F.transform(current, lambda c: c["axis"]), F.transform(current, lambda c: c["v0"]))
        without = F.array_sort(F.transform(parent, lambda p: p["v0"] - F.coalesce(F.try_element_at(own, p["axis"]), F.lit(0))))
        whole = F.array_sort(F.transform(parent, lambda p: p["v0"]))
        return F.when(current.isNotNull() & parent.isNotNull(), -(F.get(whole, at) - F.get(without, at)))

    return make


def ancestors_of(axis: str | None, pivot) -> list[M.Field]:
    """Along rows a measure's ancestors are the pivot's columns, along columns its rows."""
    if pivot is None:
        raise ValueError("a measure relative to an axis needs a pivot table")
    rows, columns = pivot
    return list(rows) if axis == "column" else list(columns)


def expanded(m: M.Measure, pivot) -> M.Measure:
    """``m`` with parametrized and axis-relative measures replaced by what they stand for."""
    if isinstance(m, M.Parametrized):
        if m.key not in PARAMETERS:
            raise ValueError(f"unknown parametrized measure {m.key}")
        given = dict(m.parameters)
        if m.key != "VAR" and (given.get("axis") is not None or "ancestors" not in given):
            given["ancestors"] = ancestors_of(given.pop("axis", None), pivot)
        for name, needed in PARAMETERS[m.key].items():
            if needed and given.get(name) is None:
                raise ValueError(f"Parameter '{name}' was expected but not provided in {m.alias}")
        parts = [(M.as_field(given["value"]), "sum"), (M.as_field(given["date"]), "any_value")]
        axis = M.as_field(given["date"])
        if m.key == "VAR":
            return M.VectorTuple(m.alias, parts, axis, value_at_risk(float(given["quantile"]), given["return"]))
        tuple_ = M.VectorTuple(f"__vector_{m.alias}", parts, axis)
        return M.Comparison(m.alias, incremental(float(given["quantile"])), tuple_, ancestors=[M.as_field(f) for f in given["ancestors"]], total=m.key.startswith("OVERALL"), clear_filters=False)
    if isinstance(m, M.AxisComparison):
        return M.Comparison(m.alias, m.method, expanded(m.measure, pivot), ancestors=ancestors_of(m.axis, pivot), total=m.total, clear_filters=m.clear_filters)
    if isinstance(m, M.Binary):
        return replace(m, left=expanded(m.left, pivot), right=expanded(m.right, pivot))
    if isinstance(m, (M.Comparison, M.GrandTotalComparison)):
        return replace(m, measure=expanded(m.measure, pivot))
    return m


def joined(c, scope, m: M.Vector | M.VectorTuple, name: str) -> DataFrame:
    """The scope's frame with the vector, or what its transform makes of it, as ``name``."""
    from ..plans.compiler import barred

    single = isinstance(m, M.Vector)
    parts = [(m.field, m.function)] if single else list(m.parts)
    dims = range(len(c.dims))
    flags = [f"g{i}" for i in dims]
    axis = c.source.column(m.axis)
    base = [M.Aggregated(f"v{i}", f, function) for i, (f, function) in enumerate(parts)]
    selected = single and c.index(m.axis) is not None
    if selected:
        vectors = c.aggregated(scope, scope.sets, base).withColumnRenamed("m0", "__vector")
    elif (key := (scope.where, scope.having, m)) in c.physical:
        vectors = c.physical[key]
    else:
        # One aggregation for the sets of all scopes of these filters, as for other measures.
        group = [s.sets for s in c.states if (s.where, s.having) == (scope.where, scope.having)]
        inner = _inner(c, replace(scope, sets=frozenset().union(scope.sets, *group)), base, axis)
        rows = F.array_sort(F.collect_list(F.struct("axis", *[F.col(f"m{i}").alias(f"v{i}") for i in range(len(parts))])))
        vectors = inner.groupBy(*[f"d{i}" for i in dims], *flags).agg(rows.alias("__vector")) if c.dims else inner.agg(rows.alias("__vector"))
        if single:
            kind = dict(inner.dtypes)["m0"]
            wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}.get(kind, kind)
            vectors = vectors.withColumn("__vector", F.transform("__vector", lambda r: r["v0"].cast(wide)))
        elif m.transform is not None:
            vectors = vectors.withColumn("__vector", m.transform(F.col("__vector")))
        c.physical[key] = vectors
    if not selected and c.dims:
        vectors = barred(vectors, c.in_sets(scope.sets))
    read = vectors.select(*[F.col(f"d{i}").alias(f"rd{i}") for i in dims], *[F.col(f).alias(f"r{f}") for f in flags], "__vector")
    left = c.frame(scope)
    condition = F.lit(True)
    for i in dims:
        condition = condition & F.col(f"d{i}").eqNullSafe(F.col(f"rd{i}")) & (F.col(f"g{i}") == F.col(f"rg{i}"))
    both = left.join(read, condition, "left") if c.dims else left.crossJoin(read)
    return both.withColumn(name, F.col("__vector")).select(*left.columns, name)


def _inner(c, scope, base: list[M.Measure], axis: Column) -> DataFrame:
    """By dimensions and axis: the axis is one more dimension that is in every grouping set."""
    from ..plans.compiler import Compiler

    inner = object.__new__(Compiler)
    inner.__dict__.update(c.__dict__)
    n = len(c.dims)
    inner.dims = [*c.dims, _Axis(axis)]
    inner.source = _AxisSource(c.source)
    sets = frozenset(s | {n} for s in scope.sets)
    return inner.aggregated(scope, sets, base).withColumnRenamed(f"d{n}", "axis")


class _Axis:
    """The axis among dimensions; it is a Column already."""

    alias = None

    def __init__(self, column: Column):
        self.column = column

    def as_(self, alias: str | None) -> _Axis:
        return self


class _AxisSource:
    def __init__(self, source):
        self.source, self.frame, self.base = source, source.frame, source.base

    def column(self, f) -> Column:
        return f.column if isinstance(f, _Axis) else self.source.column(f)
