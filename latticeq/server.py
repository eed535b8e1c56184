"""The engine over HTTP: POST a query's JSON to a route of ``service``, or GET /metadata.

``python -m latticeq.server NAME=PATH...`` serves parquet tables on port 8080.
"""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import Engine
from .service import handle


def server(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't running yet (``serve_forever``); port 0 picks a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: bytes | None) -> None:
            accept = self.headers.get("Accept", "application/json")
            status, answer = handle(engine, self.path.partition("?")[0], body, accept, self.headers.get("X-User", ""))
            text = answer if isinstance(answer, str) else json.dumps(answer, default=str)
            kind = "application/json" if not isinstance(answer, str) else "text/csv" if "csv" in accept else "text/plain"
            payload = text.encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(payload)))
            self.end_headers()
            self.wfile.write(payload)

        def do_GET(self) -> None:
            self._answer(None)

        def do_POST(self) -> None:
            self._answer(self.rfile.read(int(self.headers.get("Content-Length", 0))))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark)
    for name, path in (a.split("=", 1) for a in args):
        engine.catalog.register_later(name, lambda path=path: spark.read.parquet(path))
    server(engine).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
