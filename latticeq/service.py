"""The engine behind request bodies: a route and a JSON document in, JSON, CSV or text out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException

from .engine import Engine, LimitExceeded
from .plans.describe import formula
from .sources import codec, render

ROUTES = ("query", "query-merge", "experimental/query-join", "query-pivot", "query-merge-pivot", "expression", "metadata")


def handle(engine: Engine, route: str, body: Any = None, accept: str = "application/json", user: str = "") -> tuple[int, Any]:
    """(status, answer). ``accept`` picks JSON (a dict), ``text/csv`` or ``text/plain``.

    Bodies that aren't JSON or not of the route's form, and queries that the engine or Spark's analysis refuses,
    are answered by 400; whatever fails while running by 500. Nothing is raised.
    """
    route = route.strip("/")
    try:
        body = json.loads(body) if isinstance(body, (str, bytes)) and body else body
        if route == "metadata":
            return 200, engine.metadata()
        if route == "expression":
            measures = [codec.decode(m) for m in body]
            return 200, [{"alias": m.alias, "expression": formula(m)} for m in measures]
        if route == "experimental/query-join":
            rows = engine.join(codec.join(body))
            names, values = rows.columns, [tuple(r) for r in rows.collect()]
            if "csv" in accept:
                return 200, render.csv(names, values)
            if "plain" in accept:
                return 200, render.text(names, values)
            return 200, {"columns": names, "cells": [dict(zip(names, r, strict=True)) for r in values]}
        run = {"query": lambda: engine.query(codec.query(body), user), "query-merge": lambda: engine.merge(codec.merge(body), user, strict_limit=True), "query-pivot": lambda: engine.pivot(codec.pivot(body), user), "query-merge-pivot": lambda: engine.pivot(codec.pivot(body), user, strict_limit=True)}
        if route not in run:
            return 404, {"message": f"no route {route}"}
        result = run[route]()
        if "csv" in accept:
            return 200, result.csv()
        if "plain" in accept:
            return 200, result.text()
        return 200, result.json()
    except LimitExceeded:
        return 500, {"message": "query limit exceeded"}
    except (ValueError, KeyError, TypeError, AttributeError, AnalysisException) as error:
        return 400, {"message": str(error)}
    except Exception as error:  # the answer of a server has to come, whatever happened
        return 500, {"message": f"{type(error).__name__}: {error}"}
