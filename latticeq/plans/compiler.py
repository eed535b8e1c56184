"""From a Query to a lazy DataFrame.

A *scope* is a grain and a filter: where, having and grouping sets over the query's dimensions. All base
measures that any measure needs at a scope are collected first, so each scope is one aggregation. Scopes
that differ in grouping sets only share one aggregation over the union of their sets and read their rows
from it. Calculated measures are projections of a scope's frame or joins between two frames.

Frames use internal names: d0, d1... for dimensions, g0, g1... for their total flags (1: the row is
a total over the dimension), m0, m1... for measures. Output names appear once, in the last projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import arithmetic, criteria
from ..sources.catalog import Catalog
from . import model as M

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "any_value": F.any_value}


@dataclass(frozen=True)
class Scope:
    where: M.Criteria | None
    having: M.Criteria | None
    #: Each a set of indexes of dimensions that are not totalled.
    sets: frozenset[frozenset[int]]


@dataclass
class State:
    base: list[M.Measure] = field(default_factory=list)
    frame: DataFrame | None = None
    #: The frame before calculated measures are joined to it.
    plain: DataFrame | None = None
    columns: dict[M.Measure, str] = field(default_factory=dict)


def is_primitive(m: M.Measure) -> bool:
    if isinstance(m, M.Binary):
        return is_primitive(m.left) and is_primitive(m.right)
    return isinstance(m, (M.Aggregated, M.Expression, M.Count, M.ConstantMeasure))


def is_basic(m: M.Measure) -> bool:
    return isinstance(m, (M.Aggregated, M.Expression, M.Count))


class Source:
    """The joined tables of a query, and how fields become Columns over them."""

    def __init__(self, catalog: Catalog, table: M.Table):
        self.catalog = catalog
        self.frame = self._named(table)
        for join in table.joins:
            self._join(join)

    def _named(self, table: M.Table) -> DataFrame:
        if isinstance(table.source, M.Query):
            check_sub_query(table.source)
            return Compiler(self.catalog, table.source).result(order=False, limited=False, labels=False).alias("__query")
        if isinstance(table.source, M.VirtualTable):
            # Its rows stand in the query itself, so their number is bounded by what the caller wrote.
            return F.broadcast(self.catalog.virtual(table.source)).alias(table.source.name)
        if isinstance(table.source, DataFrame):
            return table.source.alias("__frame")
        return self.catalog.table(table.source).alias(table.source)

    def _join(self, join: M.Join) -> None:
        right = self._named(join.table)
        if join.type == "cross":
            self.frame = self.frame.crossJoin(right)
        elif join.on is None:
            raise ValueError(f"the {join.type} join has no condition; use a cross join for all pairs")
        else:
            kind = {"inner": "inner", "left": "left", "full": "full"}[join.type]
            self.frame = self.frame.join(right, criteria.predicate(join.on, self.column), kind)
        for nested in join.table.joins:
            self._join(nested)

    def column(self, f: M.Field) -> Column:
        if isinstance(f, (M.TableField, M.AliasedField)):
            return F.col(_quoted(f.name, self.frame))
        if isinstance(f, M.ConstantField):
            return F.lit(f.value)
        if isinstance(f, M.FunctionField):
            name = f.function.lower()
            if f.operand is None:
                return F.current_date() if name == "current_date" else F.call_function(name)
            return F.call_function(name, self.column(f.operand))
        return arithmetic.plain(f.op, self.column(f.left), self.column(f.right))

    def base(self, m: M.Measure) -> Column:
        """A primitive measure as an aggregate expression."""
        if isinstance(m, M.Count):
            return F.count(F.lit(1))
        if isinstance(m, M.Expression):
            return F.expr(m.sql)
        if isinstance(m, M.ConstantMeasure):
            return F.lit(m.value).cast("double" if isinstance(m.value, float) else "long")
        if isinstance(m, M.Binary):
            return arithmetic.plain(m.op, self.base(m.left), self.base(m.right))
        operand = self.column(m.field)
        if m.criterion is not None:
            operand = F.when(criteria.predicate(m.criterion, self.column), operand)
        function = m.function.lower()
        if m.distinct:
            if function == "count":
                return F.count_distinct(operand)
            if function in ("min", "max", "any_value"):
                return AGGREGATES[function](operand)
            if function == "sum":
                return F.sum_distinct(operand)
            raise ValueError(f"{function} has no distinct form here; use an expression measure")
        if function in AGGREGATES:
            return AGGREGATES[function](operand)
        return F.call_function(function, operand)


def _quoted(name: str, frame: DataFrame) -> str:
    """``name`` as a reference: quoted whole if it is a column's name, else table and column quoted apart."""
    if name in frame.columns:
        return f"`{name}`"
    table, _, column = name.rpartition(".")
    return f"`{table}`.`{column}`" if table else f"`{column}`"


def barred(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """The aggregated ``rows`` where ``condition`` holds, by a filter that the optimiser leaves where it is.

    Scopes read their rows from one aggregation. Conditions pushed into it, or measures left out of it, would make
    as many plans of it as there are readers, each with a scan of its own. With a filter above it that depends on
    no row but names all measures, its exchange is the same for all readers and is reused.
    """
    measures = [F.col(c).isNull() for c in rows.columns if c[0] == "m" and c[1:].isdigit()]
    return rows.where(F.when(reduce(lambda a, b: a | b, measures, F.rand(0) + 1.0 > 0), F.lit(True) if condition is None else condition))


def check_sub_query(q: M.Query) -> None:
    if q.column_set is not None:
        raise ValueError("a sub-query can't have a column set")
    if q.parameters:
        raise ValueError("a sub-query can't have parameters")
    for m in q.measures:
        if not is_primitive(m):
            raise ValueError(f"a sub-query can't have the measure {m.alias}: only primitive ones are allowed")


class Compiler:
    """Compiles one query; ``frames`` may hold aggregated frames kept by a cache."""

    def __init__(self, catalog: Catalog, query: M.Query, pivot: tuple[list[M.Field], list[M.Field]] | None = None, frames=None):
        from ..operators import compare, vector

        self.compare, self.vector = compare, vector
        self.catalog, self.pivot, self.frames = catalog, pivot, frames
        query = replace(query, measures=[self.vector.expanded(m, pivot) for m in query.measures])
        self.query = query
        self.selected = list(query.columns)
        fields = list(query.columns)
        if query.column_set is not None and query.column_set.field not in fields:
            fields = [query.column_set.field, *fields]
        self.hidden: list[M.Field] = []
        known = {M.output_name(f) for f in fields} | {m.alias for m in query.measures} | ({query.column_set.new_field} if query.column_set else set())
        for f, _ in query.orders:
            if M.output_name(f) not in known and f.as_(None) not in {x.as_(None) for x in fields}:
                self.hidden.append(f)
        self.dims: list[M.Field] = []
        for f in [*fields, *self.hidden]:
            if f not in self.dims:
                self.dims.append(f)
        self.source = Source(catalog, query.table)
        self.states: dict[Scope, State] = {}
        self.physical: dict[tuple, DataFrame] = {}
        self._check()
        self.scope = Scope(query.where, query.having, self._sets())
        self._prefetch(self.scope, M.Count()) if not query.measures and not self.dims else None
        for m in query.measures:
            self._prefetch(self.scope, m)

    # Checks and grouping sets

    def _check(self) -> None:
        names = [M.output_name(f) for f in self.selected]
        for f in self.query.rollup:
            if f not in self.dims and M.output_name(f) not in names:
                raise ValueError(f"the columns of rollup must be a subset of those of select; {M.output_name(f)} isn't")
        for m in criteria.measures_of(self.query.having):
            if not is_basic(m):
                raise ValueError(f"having only takes aggregates and expressions, not {m.alias}")

    def index(self, f: M.Field) -> int | None:
        """The dimension that a field stands for; an unqualified name also finds a qualified one."""
        if f in self.dims:
            return self.dims.index(f)
        for i, d in enumerate(self.dims):
            if isinstance(f, (M.TableField, M.AliasedField)) and (d.alias == f.name or (isinstance(d, M.TableField) and isinstance(f, M.TableField) and d.column == f.column and not (d.table and f.table))):
                return i
            if d.as_(None) == f.as_(None):
                return i
        return None

    def _sets(self) -> frozenset[frozenset[int]]:
        every = frozenset(range(len(self.dims)))
        own = [self.index(f) for f in self.hidden]
        if self.query.grouping_sets:
            extra = {self.index(self.query.column_set.field)} if self.query.column_set is not None else set()
            return frozenset(frozenset({self.index(f) for f in s} | set(own) | extra) for s in self.query.grouping_sets)
        rolled = [self.index(f) for f in self.query.rollup]
        rest = every - set(rolled)
        return frozenset(rest | frozenset(rolled[:k]) for k in range(len(rolled) + 1))

    # Which base measures each scope needs

    def state(self, scope: Scope) -> State:
        return self.states.setdefault(scope, State())

    def _prefetch(self, scope: Scope, m: M.Measure) -> None:
        if is_primitive(m):
            if m not in self.state(scope).base:
                self.state(scope).base.append(m)
        elif isinstance(m, M.Binary):
            self._prefetch(scope, m.left)
            self._prefetch(scope, m.right)
        elif isinstance(m, (M.Comparison, M.GrandTotalComparison)):
            self._prefetch(scope, m.measure)
            self._prefetch(self.compare.read_scope(self, scope, m), m.measure)
        else:
            self.state(scope)

    # Frames

    def _physical(self, scope: Scope) -> tuple[DataFrame, list[M.Measure]]:
        """The aggregation shared by all scopes of the same filters."""
        key = (scope.where, scope.having)
        group = [s for s in self.states if (s.where, s.having) == key]
        sets = frozenset().union(*[s.sets for s in group])
        base: list[M.Measure] = []
        for s in group:
            base += [m for m in self.states[s].base if m not in base]
        if key not in self.physical:
            build = lambda: self.aggregated(scope, sets, base)
            self.physical[key] = self.frames(self, scope, sets, base, build) if self.frames else build()
        return self.physical[key], base

    def aggregated(self, scope: Scope, sets: frozenset[frozenset[int]], base: list[M.Measure], more: list[Column] | None = None) -> DataFrame:
        """d*, g* and m* (in the order of ``base``) of every grouping set, with having applied."""
        rows = self.source.frame
        if (where := criteria.predicate(scope.where, self.source.column)) is not None:
            rows = rows.where(where)
        # Grouping columns are projected first, under internal names that no measure's operand has.
        rows = rows.withColumns({f"d{i}": self.source.column(f) for i, f in enumerate(self.dims)}) if self.dims else rows
        names = [f"d{i}" for i in range(len(self.dims))]
        aggregates = [self.source.base(m).alias(f"m{i}") for i, m in enumerate(base)]
        having = criteria.measures_of(scope.having)
        aggregates += [self.source.base(m).alias(f"h{i}") for i, m in enumerate(having)] + list(more or [])
        every = frozenset(range(len(self.dims)))
        if sets == {every}:
            if not aggregates:
                out = rows.select(*names).distinct() if names else rows.agg(F.count(F.lit(1)).alias("__n")).select()
            else:
                out = (rows.groupBy(*names) if names else rows).agg(*aggregates)
            out = out.withColumns({f"g{i}": F.lit(0) for i in every}) if names else out
        else:
            # Rows once for each set, without the dimensions that it totals. Spark's own grouping sets do the same, but
            # copies of them in one plan don't compare equal, so their exchange isn't reused.
            order = sorted(sorted(s) for s in sets)
            within = [F.col("__set").isin([k for k, s in enumerate(order) if i in s]) for i in range(len(names))]
            rows = rows.withColumn("__set", F.explode(F.array(*[F.lit(k) for k in range(len(order))])))
            rows = rows.withColumns({n: F.when(w, F.col(n)) for n, w in zip(names, within, strict=True)}) if names else rows
            out = rows.groupBy(*names, "__set").agg(*aggregates) if aggregates else rows.select(*names, "__set").distinct()
            out = out.withColumns({f"g{i}": F.when(w, 0).otherwise(1) for i, w in enumerate(within)}).drop("__set") if names else out.drop("__set")
        kept = criteria.predicate(scope.having, self._unresolved, lambda m: F.col(f"h{having.index(m)}"))
        out = out.where(kept) if kept is not None else out
        return out.drop(*[f"h{i}" for i in range(len(having))])

    def _unresolved(self, f: M.Field) -> Column:
        i = self.index(f)
        if i is None:
            raise ValueError(f"{M.output_name(f)} isn't selected")
        return F.col(f"d{i}")

    def frame(self, scope: Scope) -> DataFrame:
        """The rows of a scope, after the column set's reshaping."""
        state = self.state(scope)
        if state.frame is None:
            shared, base = self._physical(scope)
            group = frozenset().union(*[s.sets for s in self.states if (s.where, s.having) == (scope.where, scope.having)])
            if not all(map(is_primitive, self.query.measures)):
                shared = barred(shared, self.in_sets(scope.sets) if scope.sets != group else None)
            state.columns |= {m: f"m{base.index(m)}" for m in state.base}
            state.frame = state.plain = self._grouped(shared)
        return state.frame

    def in_sets(self, sets: frozenset[frozenset[int]]) -> Column:
        flags = [reduce(and_, [F.col(f"g{i}") == (0 if i in s else 1) for i in range(len(self.dims))], F.lit(True)) for s in sorted(map(sorted, sets))]
        return reduce(lambda a, b: a | b, flags)

    def mapping(self) -> DataFrame:
        """group, value, gpos, vpos of the column set, one row for each value of each group."""
        own = self.query.column_set
        kind = self.source.frame.select(self.source.column(own.field).alias("v")).schema["v"].dataType
        rows = [(g, v, a, b) for a, (g, values) in enumerate(own.groups) for b, v in enumerate(values)]
        frame = self.catalog.spark.createDataFrame([(g, None if v is None else str(v), a, b) for g, v, a, b in rows], "cs string, csv string, gpos int, vpos int")
        return frame.withColumn("csv", F.col("csv").cast(kind))

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """Each row once for every group that holds its value; others and totals of the field go."""
        if self.query.column_set is None:
            return rows
        i = self.index(self.query.column_set.field)
        # The mapping's rows are those written in the query.
        return rows.where(F.col(f"g{i}") == 0).join(F.broadcast(self.mapping()), F.col(f"d{i}").eqNullSafe(F.col("csv"))).drop("csv")

    # Measures

    def value(self, scope: Scope, m: M.Measure) -> str:
        """The name of the column that holds ``m`` in the scope's frame, added if need be."""
        self.frame(scope)
        state = self.state(scope)
        if m in state.columns:
            return state.columns[m]
        name = f"x{len(state.columns)}"
        if isinstance(m, M.ConstantMeasure):
            state.frame = state.frame.withColumn(name, self.source.base(m))
        elif isinstance(m, M.TotalCount):
            state.frame = state.frame.crossJoin(F.broadcast(state.plain.agg(F.count(F.lit(1)).alias(name))))
        elif isinstance(m, M.Binary):
            a, b = self.value(scope, m.left), self.value(scope, m.right)
            state.frame = state.frame.withColumn(name, arithmetic.between_results(m.op, F.col(a), F.col(b)))
        elif isinstance(m, (M.Comparison, M.GrandTotalComparison)):
            state.frame = self.compare.joined(self, scope, m, name)
        elif isinstance(m, (M.Vector, M.VectorTuple)):
            state.frame = self.vector.joined(self, scope, m, name)
        else:
            raise ValueError(f"{m} has no meaning here")
        state.columns[m] = name
        return name

    # Results

    def evaluated(self) -> tuple[DataFrame, dict[str, str], list[str]]:
        """The frame with all measures; output name -> internal column; the names that are measures."""
        measures = {m.alias: self.value(self.scope, m) for m in self.query.measures}
        names: dict[str, str] = {}
        if self.query.column_set is not None:
            names[self.query.column_set.new_field] = "cs"
            names[M.output_name(self.query.column_set.field)] = f"d{self.index(self.query.column_set.field)}"
        for f in self.selected:
            names.setdefault(M.output_name(f), f"d{self.index(f)}")
        return self.frame(self.scope), names | measures, list(measures)

    def outputs(self) -> list[tuple[str, str]]:
        """(output name, internal column) in order; a field that is selected twice stands twice."""
        _, names, measures = self.evaluated()
        out = []
        if self.query.column_set is not None:
            own = [self.query.column_set.new_field, M.output_name(self.query.column_set.field)]
            out += [(n, names[n]) for n in own]
            out += [(M.output_name(f), names[M.output_name(f)]) for f in self.selected if M.output_name(f) != own[1]]
        else:
            out += [(M.output_name(f), names[M.output_name(f)]) for f in self.selected]
        return out + [(n, names[n]) for n in measures]

    def result(self, order: bool = True, limited: bool = True, labels: bool = True, default_limit: int | None = None) -> DataFrame:
        from ..operators import ordering

        out = self.outputs()
        rows = self.frame(self.scope)
        if order:
            rows = rows.orderBy(*ordering.keys(self, out))
        limit = self.query.limit if self.query.limit > 0 else default_limit
        if limited and limit:
            rows = rows.limit(limit)
        label = labels and bool(self.query.rollup)
        return rows.select(*[self.labelled(c, label).alias(f"c{i}") for i, (_, c) in enumerate(out)]).toDF(*[n for n, _ in out])

    def labelled(self, column: str, label: bool) -> Column:
        """A dimension as text with totals named; a row that totals all dimensions is the grand total."""
        if not label or not column.startswith("d"):
            return F.col(column)
        own = [i for i in range(len(self.dims)) if self.dims[i] not in self.hidden]
        every = reduce(and_, [F.col(f"g{i}") == 1 for i in own])
        total = F.when(every & F.lit(self.query.column_set is None), F.lit(M.GRAND_TOTAL)).when(F.col(f"g{column[1:]}") == 1, F.lit(M.TOTAL))
        return total.otherwise(F.col(column).cast("string"))
