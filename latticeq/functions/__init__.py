"""Functions that build fields, criteria, measures and comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from ..plans import model as M

Field = M.Field


def field(name: str) -> Field:
    return M.TableField(name)


def fields(*names: str) -> list[Field]:
    return [M.TableField(n) for n in names]


def lit(value: Any) -> Field:
    return M.ConstantField(value)


# Conditions

null = M.Constant("null")
not_null = M.Constant("not_null")
true = M.Constant("true")
false = M.Constant("false")


def _compare(op: str):
    def make(value: Any) -> M.Condition:
        return M.Compare(op, value)

    return make


eq, neq, lt, le, gt, ge, like, contains = [_compare(op) for op in ("=", "<>", "<", "<=", ">", ">=", "like", "array_contains")]


def in_(*values: Any) -> M.Condition:
    return M.In(values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values)


def not_in(*values: Any) -> M.Condition:
    return M.Not(in_(*values))


def not_(condition: M.Condition) -> M.Condition:
    return M.Not(condition)


def and_(*conditions: M.Condition) -> M.Condition:
    return M.Logical("and", conditions)


def or_(*conditions: M.Condition) -> M.Condition:
    return M.Logical("or", conditions)


def criterion(left: Field | str | M.Measure, right: M.Condition | Field | str, op: str = "=") -> M.Criteria:
    """A field or measure with a condition, or two fields with an operator."""
    if isinstance(left, M.Measure):
        return M.MeasureCriterion(left, right)
    left = M.as_field(left)
    if isinstance(right, M.Condition):
        return M.FieldCriterion(left, right)
    right = M.as_field(right)
    flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    if isinstance(right, M.ConstantField):
        return M.FieldCriterion(left, M.Compare(op, right.value))
    if isinstance(left, M.ConstantField):
        return M.FieldCriterion(right, M.Compare(flipped.get(op, op), left.value))
    return M.FieldPair(left, right, op)


def all_(*criteria: M.Criteria) -> M.Criteria:
    return M.Tree("and", criteria)


def any_(*criteria: M.Criteria) -> M.Criteria:
    return M.Tree("or", criteria)


# Fields


def _function(name: str):
    def make(operand: Field | str) -> Field:
        return M.FunctionField(name, M.as_field(operand))

    return make


year, quarter, month, lower, upper, trim, abs_ = [_function(n) for n in ("year", "quarter", "month", "lower", "upper", "trim", "abs")]


def current_date() -> Field:
    return M.FunctionField("current_date")


def call(name: str, operand: Field | str | None = None) -> Field:
    return M.FunctionField(name, None if operand is None else M.as_field(operand))


# Arithmetic over fields or measures


def _arithmetic(op: str):
    def make(*args: Any) -> Any:
        """(left, right) of fields, or (alias, left, right) of measures."""
        if len(args) == 2:
            return M.BinaryField(op, M.as_field(args[0]), M.as_field(args[1]))
        return M.Binary(args[0], op, args[1], args[2])

    return make


plus, minus, multiply, divide, relative_difference = [_arithmetic(op) for op in ("+", "-", "*", "/", "relative_difference")]


# Measures


def _aggregate(function: str, distinct: bool = False):
    def make(alias: str, f: Field | str) -> M.Measure:
        return M.Aggregated(alias, M.as_field(f), function, distinct)

    return make


def _aggregate_if(function: str, distinct: bool = False):
    def make(alias: str, f: Field | str, criteria: M.Criteria) -> M.Measure:
        return M.Aggregated(alias, M.as_field(f), function, distinct, criteria)

    return make


sum_, min_, max_, avg, count, any_value = [_aggregate(f) for f in ("sum", "min", "max", "avg", "count", "any_value")]
count_distinct = _aggregate("count", True)
sum_if, min_if, max_if, avg_if, count_if = [_aggregate_if(f) for f in ("sum", "min", "max", "avg", "count")]
count_distinct_if = _aggregate_if("count", True)
count_all = M.Count()
total_count = M.TotalCount()


def aggregate(alias: str, f: Field | str, function: str, distinct: bool = False) -> M.Measure:
    return M.Aggregated(alias, M.as_field(f), function, distinct)


def expression(alias: str, sql: str) -> M.Measure:
    return M.Expression(alias, sql)


def integer(value: int) -> M.Measure:
    return M.ConstantMeasure(int(value))


def decimal(value: float) -> M.Measure:
    return M.ConstantMeasure(float(value))


def vector(alias: str, f: Field | str, function: str, axis: Field | str) -> M.Measure:
    return M.Vector(alias, M.as_field(f), function, M.as_field(axis))


def parametrized(alias: str, key: str, **parameters: Any) -> M.Measure:
    return M.Parametrized(alias, key, parameters)


# Comparisons: methods are absolute_difference, relative_difference, divide


def compare_period(alias: str, method: str, measure: M.Measure, period: M.Period, reference: Mapping[Field, str], clear_filters: bool = True) -> M.Measure:
    return M.Comparison(alias, method, measure, list(reference.items()), period=period, clear_filters=clear_filters)


def compare_parent(alias: str, method: str, measure: M.Measure, ancestors: Iterable[Field], clear_filters: bool = True) -> M.Measure:
    return M.Comparison(alias, method, measure, ancestors=list(ancestors), clear_filters=clear_filters)


def compare_ancestors_total(alias: str, method: str, measure: M.Measure, ancestors: Iterable[Field], clear_filters: bool = True) -> M.Measure:
    return M.Comparison(alias, method, measure, ancestors=list(ancestors), total=True, clear_filters=clear_filters)


def compare_grand_total(alias: str, method: str, measure: M.Measure) -> M.Measure:
    return M.GrandTotalComparison(alias, method, measure)


def compare_group(alias: str, method: str, measure: M.Measure, reference: Mapping[Field, str], clear_filters: bool = True) -> M.Measure:
    return M.Comparison(alias, method, measure, list(reference.items()), clear_filters=clear_filters)


def compare_dimension(alias: str, method: str, measure: M.Measure, f: Field, shift: str, elements: Iterable[Any] | None = None, clear_filters: bool = True) -> M.Measure:
    return M.Comparison(alias, method, measure, [(f, shift)], elements=None if elements is None else list(elements), clear_filters=clear_filters)


def compare_parent_of_axis(alias: str, method: str, measure: M.Measure, axis: str) -> M.Measure:
    return M.AxisComparison(alias, method, measure, axis)


def compare_total_of_axis(alias: str, method: str, measure: M.Measure, axis: str) -> M.Measure:
    return M.AxisComparison(alias, method, measure, axis, total=True)
