"""Criteria trees as Columns, and the clearing of filters that comparisons need."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import model as M

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "like": lambda a, b: a.like(b),
}
_LITERALS = (bool, int, float, str, decimal.Decimal, datetime.date, datetime.datetime, type(None))


def literal(value: object) -> object:
    if not isinstance(value, _LITERALS):
        raise ValueError(f"{value!r} of type {type(value).__name__} can't be a filter's value")
    return value


def condition(c: M.Condition, left: Column, field: Callable[[M.Field], Column]) -> Column:
    if isinstance(c, M.Compare):
        if c.op == "array_contains":
            return F.array_contains(left, literal(c.value))
        if c.op == "like":
            return left.like(c.value)
        return _COMPARE[c.op](left, field(c.value) if isinstance(c.value, M.Field) else F.lit(literal(c.value)))
    if isinstance(c, M.In):
        return left.isin([literal(v) for v in c.values])
    if isinstance(c, M.Not):
        return ~condition(c.condition, left, field)
    if isinstance(c, M.Logical):
        return reduce(and_ if c.op == "and" else or_, [condition(x, left, field) for x in c.conditions])
    return {"null": left.isNull(), "not_null": left.isNotNull(), "true": F.lit(True), "false": F.lit(False)}[c.kind]


def predicate(tree: M.Criteria | None, field: Callable[[M.Field], Column], measure: Callable[[M.Measure], Column] | None = None) -> Column | None:
    """None where the tree holds no condition."""
    if tree is None:
        return None
    if isinstance(tree, M.Tree):
        parts = [p for p in (predicate(c, field, measure) for c in tree.children) if p is not None]
        return reduce(and_ if tree.op == "and" else or_, parts) if parts else None
    if isinstance(tree, M.FieldPair):
        return _COMPARE[tree.op](field(tree.left), field(tree.right))
    if isinstance(tree, M.MeasureCriterion):
        if measure is None:
            raise ValueError("a measure's criterion belongs in having")
        return condition(tree.condition, measure(tree.measure), field)
    if isinstance(tree.field, M.ConstantField):
        raise ValueError("a criterion needs a field")
    return condition(tree.condition, field(tree.field), field)


def measures_of(tree: M.Criteria | None) -> list[M.Measure]:
    if tree is None:
        return []
    if isinstance(tree, M.Tree):
        return [m for c in tree.children for m in measures_of(c)]
    return [tree.measure] if isinstance(tree, M.MeasureCriterion) else []


def _plain(f: M.Field) -> M.Field:
    """A table's field without its table and alias, so that ``t.c`` and ``c`` are one."""
    return M.TableField(f.column) if isinstance(f, M.TableField) else f.as_(None)


def cleared(tree: M.Criteria | None, fields: set[M.Field]) -> M.Criteria | None:
    """``tree`` without the conditions on ``fields``; comparisons of two fields and of measures stay."""
    if isinstance(tree, M.Tree):
        kept = [c for c in (cleared(c, fields) for c in tree.children) if c is not None]
        return M.Tree(tree.op, kept) if kept else None
    if isinstance(tree, M.FieldCriterion) and _plain(tree.field) in {_plain(f) for f in fields}:
        return None
    return tree
