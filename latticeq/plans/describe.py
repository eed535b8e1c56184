"""Readable formulas of measures, and the fields that a query needs."""

from __future__ import annotations

from typing import Any

from . import model as M


def formula(m: M.Measure, inner: bool = False) -> str:
    if isinstance(m, M.Aggregated):
        body = M.output_name(m.field) if not isinstance(m.field, M.BinaryField) else "..."
        return f"{m.function}({'distinct ' if m.distinct else ''}{body})" if m.criterion is None else f"{m.function}If({body}, ...)"
    if isinstance(m, M.Expression):
        return m.sql
    if isinstance(m, (M.Count, M.TotalCount)):
        return "count(*)" if isinstance(m, M.Count) else "count(*) over ()"
    if isinstance(m, M.ConstantMeasure):
        return str(m.value)
    if isinstance(m, M.Binary):
        a, b = formula(m.left, True), formula(m.right, True)
        text = f"({a} - {b}) / {b}" if m.op == "relative_difference" else f"{a} {m.op} {b}"
        return f"({text})" if inner else text
    if isinstance(m, (M.Comparison, M.GrandTotalComparison, M.AxisComparison)):
        a = m.measure.alias
        other = f"{a}(grand total)" if isinstance(m, M.GrandTotalComparison) else f"{a}(reference)"
        if callable(m.method):
            return f"f({a}, {other})"
        return {"absolute_difference": f"{a} - {other}", "relative_difference": f"({a} - {other}) / {other}", "divide": f"{a} / {other}"}[m.method]
    if isinstance(m, M.Vector):
        return f"vector({m.function}({M.output_name(m.field)}) along {M.output_name(m.axis)})"
    return m.alias


def dependencies(x: Any) -> list[M.Field]:
    """Table fields that a query, measure, criterion or field refers to, in order, once each."""
    out: list[M.Field] = []

    def walk(v: Any) -> None:
        if isinstance(v, M.TableField):
            bare = M.TableField(v.name)
            if bare not in out:
                out.append(bare)
        elif isinstance(v, M.Node):
            for inner in vars(v).values():
                walk(inner)
        elif isinstance(v, tuple):
            for inner in v:
                walk(inner)

    walk(x)
    return out


def criteria_text(x: M.Criteria | M.Condition | None) -> str:
    if x is None:
        return "all rows"
    if isinstance(x, M.Tree):
        text = f" {x.op} ".join(criteria_text(c) for c in x.children) or "all rows"
        return f"({text})" if len(x.children) > 1 else text
    if isinstance(x, M.FieldPair):
        return f"{_field_text(x.left)} {x.op} {_field_text(x.right)}"
    if isinstance(x, M.FieldCriterion):
        return f"{_field_text(x.field)} {criteria_text(x.condition)}"
    if isinstance(x, M.MeasureCriterion):
        return f"{x.measure.alias} {criteria_text(x.condition)}"
    if isinstance(x, M.Compare):
        return f"{x.op} {x.value!r}"
    if isinstance(x, M.In):
        return f"in {list(x.values)!r}"
    if isinstance(x, M.Not):
        return f"not ({criteria_text(x.condition)})"
    if isinstance(x, M.Logical):
        return "(" + f" {x.op} ".join(criteria_text(c) for c in x.conditions) + ")"
    return x.kind.replace("_", " ")


def _field_text(f: M.Field) -> str:
    if isinstance(f, M.ConstantField):
        return repr(f.value)
    if isinstance(f, M.BinaryField):
        return f"({_field_text(f.left)} {f.op} {_field_text(f.right)})"
    return M.output_name(f)


def scopes(compiler: Any) -> str:
    """The aggregations that a compiled query makes, in the order they are needed, then its measures' formulas."""
    names = [_field_text(f) for f in compiler.dims]
    lines = []
    for i, (scope, state) in enumerate(compiler.states.items(), 1):
        sets = sorted((sorted(s) for s in scope.sets), key=lambda s: (-len(s), s))
        lines.append(f"scope {i}: {criteria_text(scope.where)}" + (f", having {criteria_text(scope.having)}" if scope.having else ""))
        lines += [f"  by ({', '.join(names[j] for j in s)})" for s in sets]
        lines += [f"  {m.alias} = {formula(m)}" for m in state.base]
    return "\n".join([*lines, "measures:", *[f"  {m.alias} = {formula(m)}" for m in compiler.query.measures]])
