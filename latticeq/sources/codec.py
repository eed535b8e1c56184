"""Queries as JSON. Objects carry ``@class``; only its last part counts, so any package prefix is accepted.

Maps whose keys are fields use the fields' JSON text as keys.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from typing import Any

from ..plans import model as M

_OPS = {"PLUS": "+", "MINUS": "-", "MULTIPLY": "*", "DIVIDE": "/", "RELATIVE_DIFFERENCE": "relative_difference"}
_CONDITIONS = {"EQ": "=", "NEQ": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">=", "LIKE": "like", "ARRAY_CONTAINS": "array_contains"}
_CONSTANTS = {"NULL": "null", "NOT_NULL": "not_null", "TRUE": "true", "FALSE": "false"}
_back = lambda d: {v: k for k, v in d.items()}


def _tag(x: dict[str, Any]) -> str:
    return x["@class"].rpartition(".")[2].rpartition("$")[2].removesuffix("Dto")


def _fields(items: list | None) -> list[M.Field]:
    return [decode(f) for f in items or []]


def _keyed(x: dict[str, Any] | None) -> list[tuple[M.Field, Any]]:
    return [(decode(json.loads(k)), v) for k, v in (x or {}).items()]


def _value(v: Any) -> Any:
    return decode(v) if isinstance(v, dict) and "@class" in v else v


def _criteria(x: dict[str, Any] | None) -> M.Criteria | None:
    if x is None:
        return None
    op = x.get("conditionType")
    if x.get("children"):
        return M.Tree(op.lower(), [_criteria(c) for c in x["children"]])
    if x.get("fieldOther"):
        from ..functions import criterion

        return criterion(decode(x["field"]), decode(x["fieldOther"]), _CONDITIONS[op])
    if x.get("measure"):
        return M.MeasureCriterion(decode(x["measure"]), decode(x["condition"]))
    return M.FieldCriterion(decode(x["field"]), decode(x["condition"])) if x.get("field") else None


def _order(x: dict[str, Any]) -> Any:
    if _tag(x) == "ExplicitOrder":
        return M.ExplicitOrder(x["explicit"])
    return M.SimpleOrder(x.get("order") == "DESC", x.get("nullsOrder") == "LAST")


def _parameters(items: dict[str, Any]) -> list[tuple[str, Any]]:
    out = []
    for k, v in (items or {}).items():
        if isinstance(v, dict) and v.get("@class", "").endswith("QueryCacheParameter"):
            out.append(("cache", v["action"]))
        else:
            out.append((k, v))
    return out


_DECODERS: dict[str, Callable[[dict[str, Any]], Any]] = {
    "TableField": lambda x: M.TableField(x["fullName"], x.get("alias")),
    "AliasedField": lambda x: M.AliasedField(x["alias"]),
    "ConstantField": lambda x: M.ConstantField(x["value"], x.get("alias")),
    "FunctionField": lambda x: M.FunctionField(x.get("functionName") or x.get("function"), decode(x["operand"]) if x.get("operand") else None, x.get("alias")),
    "BinaryOperationField": lambda x: M.BinaryField(_OPS[x["operator"]], decode(x["leftOperand"]), decode(x["rightOperand"]), x.get("alias")),
    "SingleValueCondition": lambda x: M.Compare(_CONDITIONS[x["type"]], _value(x["value"])),
    "ConstantCondition": lambda x: M.Constant(_CONSTANTS[x["type"]]),
    "InCondition": lambda x: M.In(x["values"]),
    "NotCondition": lambda x: M.Not(decode(x["c"])),
    "LogicalCondition": lambda x: M.Logical(x["type"].lower(), [decode(x["one"]), decode(x["two"])]),
    "Criteria": _criteria,
    "AggregatedMeasure": lambda x: M.Count() if x["alias"] == M.COUNT_ALIAS else M.Aggregated(x["alias"], decode(x["field"]), x["aggregationFunction"].lower(), bool(x.get("distinct")), _criteria(x.get("criteria"))),
    "ExpressionMeasure": lambda x: M.Expression(x["alias"], x["expression"]),
    "CountMeasure": lambda x: M.Count(),
    "TotalCountMeasure": lambda x: M.TotalCount(),
    "BinaryOperationMeasure": lambda x: M.Binary(x["alias"], _OPS[x["operator"]], decode(x["leftOperand"]), decode(x["rightOperand"])),
    "LongConstantMeasure": lambda x: M.ConstantMeasure(int(x["value"])),
    "DoubleConstantMeasure": lambda x: M.ConstantMeasure(float(x["value"])),
    "ComparisonMeasureReferencePosition": lambda x: M.Comparison(x["alias"], x["comparisonMethod"].lower(), decode(x["measure"]), _keyed(x.get("referencePosition")), decode(x["period"]) if x.get("period") else None, _fields(x["ancestors"]) if x.get("ancestors") is not None else None, bool(x.get("grandTotalAlongAncestors")), x.get("elements"), x.get("clearFilters", True) is not False),
    "ComparisonMeasureGrandTotal": lambda x: M.GrandTotalComparison(x["alias"], x["comparisonMethod"].lower(), decode(x["measure"])),
    "PartialHierarchicalComparisonMeasure": lambda x: M.AxisComparison(x["alias"], x["comparisonMethod"].lower(), decode(x["measure"]), x["axis"].lower(), bool(x.get("grandTotalAlongAncestors")), x.get("clearFilters", True) is not False),
    "VectorAggMeasure": lambda x: M.Vector(x["alias"], decode(x["fieldToAggregate"]), x["aggregationFunction"].lower(), decode(x["vectorAxis"])),
    "ParametrizedMeasure": lambda x: M.Parametrized(x["alias"], x["key"], {k: [_value(i) for i in v] if isinstance(v, list) else v.lower() if k == "axis" and v else _value(v) for k, v in (x.get("parameters") or {}).items()}),
    "Year": lambda x: M.Year(decode(x["year"])),
    "Semester": lambda x: M.Semester(decode(x["semester"]), decode(x["year"])),
    "Quarter": lambda x: M.Quarter(decode(x["quarter"]), decode(x["year"])),
    "Month": lambda x: M.Month(decode(x["month"]), decode(x["year"])),
    "GroupColumnSet": lambda x: M.Group(M.output_name(decode(x["newField"])), decode(x["field"]), list(x["values"].items())),
}


def decode(x: dict[str, Any]) -> Any:
    if (tag := _tag(x)) not in _DECODERS:
        raise ValueError(f"unknown class {tag}")
    return _DECODERS[tag](x)


def _table(x: dict[str, Any], virtual: dict[str, M.VirtualTable]) -> M.Table:
    source: Any = query(x["subQuery"]) if x.get("subQuery") else virtual.get(x["name"], x["name"])
    return M.Table(source, [M.Join(_table(j["table"], virtual), j["type"].lower(), _criteria(j.get("joinCriteria"))) for j in x.get("joins") or []])


def query(x: dict[str, Any]) -> M.Query:
    virtual = {v["name"]: M.VirtualTable(v["name"], v["fields"], v["records"]) for v in x.get("virtualTableDtos") or []}
    sets = [decode(v) for v in (x.get("columnSets") or {}).values()]
    return M.Query(
        _table(x["table"], virtual), _fields(x.get("columns")), [decode(m) for m in x.get("measures") or []], sets[0] if sets else None, _criteria(x.get("whereCriteriaDto")), _criteria(x.get("havingCriteriaDto")),
        _fields(x.get("rollupColumns")), (), [(f, _order(o)) for f, o in _keyed(x.get("orders"))], int(x.get("limit", -1)), x.get("minify"), _parameters(x.get("parameters")),
    )


def merge(x: dict[str, Any]) -> M.MergeQuery:
    return M.MergeQuery([query(q) for q in x["queries"]], [j.lower() for j in x["joinTypes"]], x.get("minify"))


def join(x: dict[str, Any]) -> M.JoinQuery:
    queries = [query(q) for q in x["queries"]]
    joins = (x.get("table") or {}).get("joins") or []
    others = [(q, j["type"].lower(), _criteria(j.get("joinCriteria"))) for q, j in zip(queries[1:], joins, strict=True)]
    return M.JoinQuery(queries[0], others, _criteria(x.get("where")), [(f, _order(o)) for f, o in _keyed(x.get("orders"))], int(x.get("limit", -1)))


def pivot(x: dict[str, Any]) -> M.PivotQuery:
    inner = x["query"]
    return M.PivotQuery(merge(inner) if "queries" in inner else query(inner), _fields(x["rows"]), _fields(x["columns"]), _fields(x.get("hiddenTotals")), inner.get("minify") if x.get("minify") is None else x["minify"])


# Writing


def encode(x: Any) -> Any:
    """JSON values of a field, criterion, measure, period, order, column set or query."""
    ops, kinds, constants = _back(_OPS), _back(_CONDITIONS), _back(_CONSTANTS)
    if isinstance(x, M.TableField):
        return {"@class": "TableField", "fullName": x.name, "tableName": x.table, "fieldName": x.column, "alias": x.alias}
    if isinstance(x, M.AliasedField):
        return {"@class": "AliasedField", "alias": x.alias or x.name}
    if isinstance(x, M.ConstantField):
        return {"@class": "ConstantField", "value": x.value, "alias": x.alias}
    if isinstance(x, M.FunctionField):
        return {"@class": "FunctionField", "functionName": x.function, "operand": encode(x.operand), "alias": x.alias}
    if isinstance(x, M.BinaryField):
        return {"@class": "BinaryOperationField", "operator": ops[x.op], "leftOperand": encode(x.left), "rightOperand": encode(x.right), "alias": x.alias}
    if isinstance(x, M.Compare):
        return {"@class": "SingleValueCondition", "type": kinds[x.op], "value": encode(x.value)}
    if isinstance(x, M.Constant):
        return {"@class": "ConstantCondition", "type": constants[x.kind]}
    if isinstance(x, M.In):
        return {"@class": "InCondition", "type": "IN", "values": [encode(v) for v in x.values]}
    if isinstance(x, M.Not):
        return {"@class": "NotCondition", "c": encode(x.condition)}
    if isinstance(x, M.Logical):
        one, *rest = x.conditions
        return encode(one) if not rest else {"@class": "LogicalCondition", "type": x.op.upper(), "one": encode(one), "two": encode(M.Logical(x.op, rest))}
    if isinstance(x, M.Tree):
        return {"@class": "Criteria", "conditionType": x.op.upper(), "children": [encode(c) for c in x.children]}
    if isinstance(x, M.FieldPair):
        return {"@class": "Criteria", "field": encode(x.left), "fieldOther": encode(x.right), "conditionType": kinds[x.op]}
    if isinstance(x, M.MeasureCriterion):
        return {"@class": "Criteria", "measure": encode(x.measure), "condition": encode(x.condition)}
    if isinstance(x, M.FieldCriterion):
        return {"@class": "Criteria", "field": encode(x.field), "condition": encode(x.condition)}
    if isinstance(x, M.Count):
        return {"@class": "CountMeasure", "alias": x.alias}
    if isinstance(x, M.TotalCount):
        return {"@class": "TotalCountMeasure", "alias": x.alias}
    if isinstance(x, M.Aggregated):
        return {"@class": "AggregatedMeasure", "alias": x.alias, "field": encode(x.field), "aggregationFunction": x.function, "distinct": x.distinct, "criteria": encode(x.criterion)}
    if isinstance(x, M.Expression):
        return {"@class": "ExpressionMeasure", "alias": x.alias, "expression": x.sql}
    if isinstance(x, M.Binary):
        return {"@class": "BinaryOperationMeasure", "alias": x.alias, "operator": ops[x.op], "leftOperand": encode(x.left), "rightOperand": encode(x.right)}
    if isinstance(x, M.ConstantMeasure):
        return {"@class": "DoubleConstantMeasure" if isinstance(x.value, float) else "LongConstantMeasure", "value": x.value}
    if isinstance(x, M.Comparison):
        reference = {json.dumps(encode(f)): s for f, s in x.reference}
        return {"@class": "ComparisonMeasureReferencePosition", "alias": x.alias, "comparisonMethod": x.method.upper(), "measure": encode(x.measure), "referencePosition": reference or None, "period": encode(x.period), "ancestors": None if x.ancestors is None else [encode(f) for f in x.ancestors], "grandTotalAlongAncestors": x.total, "elements": None if x.elements is None else list(x.elements), "clearFilters": x.clear_filters}
    if isinstance(x, M.GrandTotalComparison):
        return {"@class": "ComparisonMeasureGrandTotal", "alias": x.alias, "comparisonMethod": x.method.upper(), "measure": encode(x.measure)}
    if isinstance(x, M.AxisComparison):
        return {"@class": "PartialHierarchicalComparisonMeasure", "alias": x.alias, "comparisonMethod": x.method.upper(), "measure": encode(x.measure), "axis": x.axis.upper(), "grandTotalAlongAncestors": x.total, "clearFilters": x.clear_filters}
    if isinstance(x, M.Vector):
        return {"@class": "VectorAggMeasure", "alias": x.alias, "fieldToAggregate": encode(x.field), "aggregationFunction": x.function, "vectorAxis": encode(x.axis)}
    if isinstance(x, M.Parametrized):
        return {"@class": "ParametrizedMeasure", "alias": x.alias, "key": x.key, "parameters": {k: [encode(i) for i in v] if isinstance(v, tuple) else encode(v) for k, v in x.parameters}}
    if isinstance(x, M.Period):
        return {"@class": type(x).__name__, **{n: encode(f) for n, f in vars(x).items()}}
    if isinstance(x, M.SimpleOrder):
        return {"@class": "SimpleOrder", "order": "DESC" if x.descending else "ASC", "nullsOrder": "LAST" if x.nulls_last else "FIRST"}
    if isinstance(x, M.ExplicitOrder):
        return {"@class": "ExplicitOrder", "explicit": list(x.values)}
    if isinstance(x, M.Group):
        return {"@class": "GroupColumnSet", "newField": encode(M.TableField(x.new_field)), "field": encode(x.field), "values": {g: list(v) for g, v in x.groups}}
    if isinstance(x, M.Query):
        virtual: list[M.VirtualTable] = []
        table = _encode_table(x.table, virtual)
        return {"table": table, "virtualTableDtos": [{"name": v.name, "fields": list(v.fields), "records": [list(r) for r in v.records]} for v in virtual], "columns": [encode(f) for f in x.columns], "rollupColumns": [encode(f) for f in x.rollup], "columnSets": {"GROUP": encode(x.column_set)} if x.column_set else {}, "measures": [encode(m) for m in x.measures], "whereCriteriaDto": encode(x.where), "havingCriteriaDto": encode(x.having), "orders": {json.dumps(encode(f)): encode(o) for f, o in x.orders}, "limit": x.limit, "minify": x.minify, "parameters": {k: {"@class": "QueryCacheParameter", "action": v} if k == "cache" else v for k, v in x.parameters}}
    if isinstance(x, M.MergeQuery):
        return {"queries": [encode(q) for q in x.queries], "joinTypes": [j.upper() for j in x.joins], "minify": x.minify}
    if isinstance(x, M.JoinQuery):
        joins = [{"type": how.upper(), "joinCriteria": encode(on)} for _, how, on in x.others]
        return {"queries": [encode(q) for q in (x.first, *(q for q, _, _ in x.others))], "table": {"joins": joins}, "where": encode(x.where), "orders": {json.dumps(encode(f)): encode(o) for f, o in x.orders}, "limit": x.limit}
    if isinstance(x, M.PivotQuery):
        return {"query": encode(x.query), "rows": [encode(f) for f in x.rows], "columns": [encode(f) for f in x.columns], "hiddenTotals": [encode(f) for f in x.hidden_totals], "minify": x.minify}
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return x


def _encode_table(t: M.Table, virtual: list[M.VirtualTable]) -> dict[str, Any]:
    if isinstance(t.source, M.VirtualTable):
        virtual.append(t.source)
    source = {"subQuery": encode(t.source)} if isinstance(t.source, M.Query) else {"name": t.name}
    return source | {"joins": [{"table": _encode_table(j.table, virtual), "type": j.type.upper(), "joinCriteria": encode(j.on)} for j in t.joins]}
