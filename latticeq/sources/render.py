"""Results as JSON cells, CSV and text. These run on the driver over rows that a limit bounds."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any


def csv(header: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    def cell(v: Any) -> str:
        text = ("true" if v else "false") if isinstance(v, bool) else "null" if v is None else str(v)
        text = text.replace('"', '""')
        return f'"{text}"' if "," in text or "\n" in text else text

    return "\n".join(",".join(map(cell, r)) for r in [header, *rows])


def text(header: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """A grid with right-justified cells."""
    cells = [[("null" if v is None else str(v)) for v in r] for r in [header, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(header))]
    line = lambda r: "| " + " | ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) + " |"
    rule = "+-" + "-+-".join("-" * w for w in widths) + "-+"
    return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule])


def cells(names: Sequence[str], measures: Sequence[str], rows: Sequence[Sequence[Any]], totals: Sequence[Sequence[bool]], minify: bool | None = None) -> list[dict[str, Any]]:
    """A map for each row, without cells that are totals; measures null in all rows go unless minify is False."""
    dead = {m for m in measures if all(r[i] is None for r in rows for i, n in enumerate(names) if n == m)} if minify is not False and rows else set()
    return [{n: v for n, v, t in zip(names, r, flags, strict=True) if not t and n not in dead} for r, flags in zip(rows, totals, strict=True)]
