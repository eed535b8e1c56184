"""Queries sent to a server of ``latticeq.server``."""

from __future__ import annotations

import json
from typing import Any
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from .plans import model as M
from .sources import codec


class Client:
    def __init__(self, url: str, user: str = ""):
        self.url, self.user = url.rstrip("/"), user

    def _send(self, route: str, body: Any = None, accept: str = "application/json") -> Any:
        data = None if body is None else json.dumps(body, default=str).encode("utf-8")
        request = Request(f"{self.url}/{route}", data, {"Content-Type": "application/json", "Accept": accept, "X-User": self.user})
        try:
            with urlopen(request) as answer:
                text = answer.read().decode("utf-8")
        except HTTPError as error:
            raise RuntimeError(json.loads(error.read())["message"]) from error
        return json.loads(text) if "json" in accept else text

    def metadata(self) -> dict[str, Any]:
        return self._send("metadata")

    def run(self, q: M.Query | M.MergeQuery | M.JoinQuery | M.PivotQuery, accept: str = "application/json") -> Any:
        """The answer to any query: a dict, or with ``text/csv`` or ``text/plain`` a string."""
        route = "query"
        if isinstance(q, M.MergeQuery):
            route = "query-merge"
        elif isinstance(q, M.JoinQuery):
            route = "experimental/query-join"
        elif isinstance(q, M.PivotQuery):
            route = "query-merge-pivot" if isinstance(q.query, M.MergeQuery) else "query-pivot"
        return self._send(route, codec.encode(q), accept)

    def expressions(self, measures: list[M.Measure]) -> list[dict[str, str]]:
        return self._send("expression", [codec.encode(m) for m in measures])
