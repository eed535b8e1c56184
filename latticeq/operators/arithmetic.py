"""Arithmetic inside aggregates (SQL's rules) and between aggregated results (missing values as absent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(op: str, a: Column, b: Column) -> Column:
    """Nulls propagate; division by zero is null."""
    if op == "relative_difference":
        return F.try_divide(a - b, b)
    if op == "/":
        return F.try_divide(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def ieee(a: Column, b: Column) -> Column:
    """Division of doubles as in IEEE 754: zero divisors give NaN or infinities, nulls propagate."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, F.try_divide(a, b)).otherwise(zero)


def between_results(op: str, a: Column, b: Column) -> Column:
    """Sums and differences take a missing side as absent (``null - b`` is ``b``); the rest propagate nulls."""
    if op == "+":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if op == "-":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a - b)
    if op == "*":
        return a * b
    if op == "relative_difference":
        return F.when(a.isNotNull() & b.isNotNull(), ieee(a - b, b))
    return ieee(a, b)


METHODS = {"absolute_difference": "-", "relative_difference": "relative_difference", "divide": "/"}


def compared(method: object, current: Column, other: Column) -> Column:
    """``method`` is one of METHODS or a function of two Columns."""
    if callable(method):
        return method(current, other)
    return between_results(METHODS[method], current, other)
