"""Secret scans with multipart credential linking.

Strong spans come from three patterns (assignments, access identifiers, hex runs). Weak parts, which
alone would raise false alarms, are identifiers given by name, bare mixed-character keys and
endpoints. Inside a scope (a run of lines without a blank one) every part stands for the interval of
its span widened by ``reach``; two sorted interval lists are joined by bisection, and a weak part is
reported only where its complements co-occur: a key with an identifier, a named identifier with a
key or an assignment, an endpoint with both.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import text as X

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Runs of one class: asking for the least length finds the same runs as finding all and dropping short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|account_?id|key_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+.]{1,15}://[^\s"'<>]{3,}""")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]


def _mixed(s: str) -> bool:
    return any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and any("0" <= c <= "9" for c in s)


def strong_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, in order."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Near:
    """Spans in one sorted list, asked whether any of them lies within reach of another in its scope."""

    def __init__(self, spans: list[tuple[int, int]], scopes: list[int], reach: int):
        self.spans, self.scopes, self.reach = sorted(spans), scopes, reach
        self.ends = list(accumulate((e for _, e in self.spans), max))

    def __call__(self, start: int, end: int) -> bool:
        scope = bisect_left(self.scopes, start + 1)
        lo = max(start - self.reach, self.scopes[scope - 1] if scope else 0)
        hi = min(end + self.reach, self.scopes[scope] if scope < len(self.scopes) else end + self.reach)
        at = bisect_right(self.ends, lo)  # all before end at lo or earlier
        while at < len(self.spans) and self.spans[at][0] < hi:
            if self.spans[at][1] > lo and self.spans[at] != (start, end):
                return True
            at += 1
        return False


def linked_spans(text: str, strong: list[Span], reach: int = 300) -> list[Span]:
    """Weak parts whose complements co-occur, as (start, kind, end)."""
    named = [(m.start(), m.end()) for m in _IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    ids = [(s, e) for s, k, e in strong if k == 1] + named
    if not ids:
        return []
    scopes = [m.start() + 1 for m in _BLANK.finditer(text)]
    taken = _Near([(s, e) for s, _, e in strong] + named, [], 0)
    keys = [(m.start(), m.end()) for m in _KEY.finditer(text) if _mixed(m[0]) and not taken(m.start(), m.end())]
    near_id = _Near(ids, scopes, reach)
    keys = [k for k in keys if near_id(*k)]
    near_key = _Near(keys + [(s, e) for s, k, e in strong if k != 1], scopes, reach)
    out = [(s, 4, e) for s, e in keys] + [(s, 3, e) for s, e in named if near_key(s, e)]
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text) if near_id(m.start(), m.end()) and near_key(m.start(), m.end())]
    return out


def all_spans(text: str | None, reach: int = 300) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and linked spans together; both ordered by start, then kind."""
    text = text or ""
    strong = strong_spans(text)
    return strong, sorted({*strong, *linked_spans(text, strong, reach)})


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """``text`` with every reported span replaced; spans that touch or overlap are replaced as one."""
    if not text:
        return text
    out, at, spans = [], 0, all_spans(text)[1]
    if not spans:
        return text
    for s, _, e in spans:
        if s > at or not out:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 300) -> DataFrame:
    """Per row: key, counts of base spans, their digest, and all spans as text.

    Positions are code points, ends exclusive; a span is that of the whole match. Null and empty texts
    have no spans (the digest of the empty string). Null keys and repeated rows give a row each, an
    empty table none. Texts are scanned whole; work on a text is linear but for lookups by bisection.
    """
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for t in batch.column(1):
                base, every = all_spans(t.as_py(), reach)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return documents.select(key, text).mapInArrow(run, schema)


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the reported spans of ``text`` replaced; n_chars, where present, follows."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for lo, hi, _, _ in X.pieces(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                old = part.column(at).to_pylist()
                new = [redacted(t) for t in old]
                columns = [pa.array(new, part.schema.field(i).type) if i == at else c for i, c in enumerate(part.columns)]
                if "n_chars" in names:
                    i = names.index("n_chars")
                    sizes = part.column(i).to_pylist()
                    columns[i] = pa.array([len(b) if b is not None and b != a else n for a, b, n in zip(old, new, sizes, strict=True)], part.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
