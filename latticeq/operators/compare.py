"""Comparisons of a measure with itself at another position, as left joins of two frames.

Written rows find their reference by key: the same dimensions and total flags, but for those that the
comparison moves. Keys join null-safe, which Spark plans as an equi-join. Without a match the result is null.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import model as M
from . import arithmetic
from .criteria import cleared


def kind(c, m: M.Measure) -> str:
    if isinstance(m, M.GrandTotalComparison):
        return "grand_total"
    if m.period is not None:
        return "period"
    if m.ancestors is not None:
        return "parent"
    return "group" if c.query.column_set is not None else "dimension"


def shift(text: str) -> int | str:
    """``y-1`` gives -1, ``y`` 0, ``first`` itself."""
    if text == "first":
        return text
    if not (found := re.fullmatch(r"[a-zA-Z]+(?:([+-])(\d+))?", text)):
        raise ValueError(f"unknown transformation {text!r}")
    return int(found[2] or 0) * (-1 if found[1] == "-" else 1)


def read_scope(c, scope, m: M.Measure):
    from ..plans.compiler import Scope

    if isinstance(m, M.GrandTotalComparison):
        return Scope(scope.where, scope.having, frozenset({frozenset()}))
    sets, fields = scope.sets, {f for f, _ in m.reference}
    if c.query.column_set is not None:
        fields.add(c.query.column_set.field)
    if m.period is not None:
        fields |= set(m.period.fields)
    if m.ancestors is not None:
        fields |= set(m.ancestors)
        chosen = [i for i in (c.index(f) for f in m.ancestors) if i is not None]
        rest = frozenset(range(len(c.dims))) - set(chosen)
        sets = sets | {rest | frozenset(chosen[:k]) for k in range(len(chosen) + 1)} | {frozenset()}
    return Scope(cleared(scope.where, fields) if m.clear_filters else scope.where, scope.having, sets)


def joined(c, scope, m: M.Measure, name: str) -> DataFrame:
    """The scope's frame with the comparison's value as a new column ``name``."""
    current = c.value(scope, m.measure)
    other_scope = read_scope(c, scope, m)
    other = c.value(other_scope, m.measure)
    # A base measure is read from the aggregation itself, not from what other comparisons made of it.
    state = c.state(other_scope)
    left, right = c.frame(scope), state.plain if other in state.plain.columns else c.frame(other_scope)
    dims = range(len(c.dims))
    grouped = c.query.column_set is not None
    read = right.select(*[F.col(f"d{i}").alias(f"rd{i}") for i in dims], *[F.col(f"g{i}").alias(f"rg{i}") for i in dims], *([F.col("cs").alias("rcs"), F.col("gpos").alias("rgpos")] if grouped else []), F.col(other).alias("rvalue"), F.lit(True).alias("rfound"))
    value = [F.col(f"d{i}") for i in dims]
    flag = [F.col(f"g{i}") for i in dims]
    ok: Column | None = None
    how = kind(c, m)
    if how == "grand_total":
        value, flag = [F.lit(None)] * len(value), [F.lit(1)] * len(flag)
    elif how == "period":
        value, ok = _period(c, m, value)
    elif how == "parent":
        value, flag = _parent(c, m, value, flag)
    elif how == "group":
        left, value, ok = _group(c, m, left, value)
    else:
        left, value, ok = _dimension(c, m, left, right, value)
    extra = [x for x in left.columns if x.startswith("__")]
    if how == "grand_total" and not grouped:
        # One row, the global aggregate's, so the broadcast has a fixed size.
        total = read.where(reduce(and_, [F.col(f"rg{i}") == 1 for i in dims], F.lit(True))).select("rvalue", "rfound")
        both = left.join(F.broadcast(total), F.lit(True), "left")
    else:
        keys = [v.eqNullSafe(F.col(f"rd{i}")) for i, v in enumerate(value)]
        keys += [f == F.col(f"rg{i}") for i, f in enumerate(flag)]
        if grouped:
            keys += [F.col("cs") == F.col("rcs"), F.col("gpos") == F.col("rgpos")]
        if ok is not None:
            keys.append(ok)
        both = left.join(read, reduce(and_, keys, F.lit(True)), "left")
    result = F.when(F.col("rfound"), arithmetic.compared(m.method, F.col(current), F.col("rvalue")))
    return both.withColumn(name, result).select(*[x for x in left.columns if x not in extra], name)


def _period(c, m: M.Comparison, value: list[Column]) -> tuple[list[Column], Column]:
    period, moves = m.period, {f: shift(s) for f, s in m.reference}
    places = [c.index(f) for f in period.fields]
    for f, i in zip(period.fields, places, strict=True):
        if i is None:
            raise ValueError(f"{M.output_name(f)} of the period must be selected")
    if "first" in moves.values():
        raise ValueError("a period comparison can't be with the first one")
    by = {c.index(f): s for f, s in moves.items()}
    year = F.col(f"d{places[-1]}")
    years = by.get(places[-1], 0)
    value = list(value)
    ok = F.lit(True)
    for i in places:
        if by.get(i, 0):
            ok = ok & (F.col(f"g{i}") == 0)
    if len(places) == 1:
        value[places[0]] = year + F.lit(years)
        return value, ok
    part, k = F.col(f"d{places[0]}"), period.per_year
    moved = by.get(places[0], 0)
    if moved:
        at = year * k + part - 1 + (moved + k * years)
        value[places[-1]] = F.floor(at / k)
        value[places[0]] = F.pmod(at, F.lit(k)) + 1
    else:
        value[places[-1]] = year + F.lit(years)
    return value, ok


def _parent(c, m: M.Comparison, value: list[Column], flag: list[Column]) -> tuple[list[Column], list[Column]]:
    chosen = [i for i in (c.index(f) for f in m.ancestors) if i is not None]
    value, flag = list(value), list(flag)
    done = F.lit(False)
    for i in reversed(chosen):
        own = F.col(f"g{i}")
        move = F.lit(True) if m.total else (own == 0) & ~done
        done = done | move
        value[i] = F.when(~move, F.col(f"d{i}"))
        flag[i] = F.when(move, F.lit(1)).otherwise(own)
    return value, flag


def _group(c, m: M.Comparison, left: DataFrame, value: list[Column]) -> tuple[DataFrame, list[Column], Column]:
    own, moves = c.query.column_set, dict(m.reference)
    place = c.index(own.field)
    move: int | str = 0
    for f, s in moves.items():
        if isinstance(f, M.Field) and c.index(f) == place:
            move = shift(s)
        elif shift(s) != 0:
            raise ValueError("only the column set's field can move, not its group")
    rows = c.mapping()
    target = rows.select(F.col("cs").alias("__cs"), F.col("gpos").alias("__g"), F.col("vpos").alias("__t"), F.col("csv").alias("__target"))
    at = F.lit(0) if move == "first" else F.greatest(F.col("vpos") + move, F.lit(0))
    pairs = rows.select(F.col("cs").alias("__c"), F.col("gpos").alias("__p"), F.col("vpos").alias("__v"), at.alias("__t"))
    pairs = pairs.join(target.withColumnRenamed("__t", "__t2"), (F.col("__p") == F.col("__g")) & (F.col("__t") == F.col("__t2"))).select("__p", "__v", "__target", F.lit(True).alias("__hit"))
    left = left.join(F.broadcast(pairs), (F.col("gpos") == F.col("__p")) & (F.col("vpos") == F.col("__v")), "left")
    value = list(value)
    value[place] = F.col("__target")
    return left, value, F.coalesce(F.col("__hit"), F.lit(False))


def _dimension(c, m: M.Comparison, left: DataFrame, right: DataFrame, value: list[Column]) -> tuple[DataFrame, list[Column], Column]:
    if not m.reference:
        raise ValueError("a comparison needs a period, ancestors or a reference position")
    f, text = m.reference[0]
    place, move = c.index(f), shift(text)
    if place is None:
        raise ValueError(f"{M.output_name(f)} must be selected")
    own = F.col(f"d{place}")
    rank = F.lit(0)
    if m.elements:
        rank = F.lit(len(m.elements))
        for i, e in reversed(list(enumerate(m.elements))):
            rank = F.when(own.eqNullSafe(F.lit(e)), F.lit(i)).otherwise(rank)
    values = right.where(F.col(f"g{place}") == 0).select(own.alias("__v"), rank.alias("__r")).distinct()
    first = F.struct("__r", "__v")
    if move == "first":
        target = values.agg(F.min(first).alias("__m")).select(F.col("__m.__v").alias("__target"), F.lit(True).alias("__hit"))
        left = left.join(F.broadcast(target), F.col(f"g{place}") == 0, "left")
    else:
        # One row for each distinct value of an aggregated dimension.
        order = Window.orderBy("__r", "__v")
        start = F.first(F.col("__v")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        place_of = F.row_number().over(order)
        if move <= 0:
            aim = F.when(place_of + move >= 1, F.lag("__v", -move).over(order) if move else F.col("__v")).otherwise(start)
            hit = F.lit(True)
        else:
            aim, hit = F.lead("__v", move).over(order), F.lead(F.lit(True), move, False).over(order)
        target = values.select(F.col("__v").alias("__key"), aim.alias("__target"), hit.alias("__hit"))
        left = left.join(target, own.eqNullSafe(F.col("__key")) & (F.col(f"g{place}") == 0), "left")
    value = list(value)
    value[place] = F.col("__target")
    return left, value, F.coalesce(F.col("__hit"), F.lit(False))
