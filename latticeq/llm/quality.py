"""Quality rules as a short-circuit cascade.

Each rule asks for quantities of the texts and says which of them it rejects. On a random sample of bounded
size every rule's cost (seconds a row for the quantities that it needs and no earlier step has worked out) and
selectivity (share rejected of the rows that are left) are estimated; the rule with the most rejections per
cost comes first, and the estimates of the others are taken anew on what it leaves. Each rule then measures
only rows that all before it kept. A document's verdict doesn't depend on the order, so neither sample nor
timing changes the result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the quantities ``needs`` of some rows, as arrays in that order; True rejects."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


class Piece:
    """Bytes of some rows, which quantities are worked out from."""

    def __init__(self, data: np.ndarray, at: np.ndarray, tokens: X.Words | None = None):
        self.data, self.at, self.n = data, at, len(at) - 1
        self._tokens = tokens

    @property
    def tokens(self) -> X.Words:
        if self._tokens is None:
            self._tokens = X.words(self.data, self.at)
        return self._tokens

    def of(self, rows: np.ndarray) -> Piece:
        """The piece of these rows alone; words that are known already aren't split again."""
        if len(rows) == self.n:
            return self
        take, at = _ranges(self.at, rows)
        tokens = None
        if (old := self._tokens) is not None:
            words, cuts = _ranges(old.rows, rows)
            move = np.repeat(at[:-1] - self.at[rows], np.diff(cuts))
            tokens = X.Words(old.starts[words] + move, old.ends[words] + move, old.hashes[words], cuts)
        return Piece(self.data[take], at, tokens)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


def _ranges(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the given rows' ranges, one after the other, and where each begins among them."""
    lengths = at[rows + 1] - at[rows]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(at[rows] - cuts[:-1], lengths) + np.arange(cuts[-1]), cuts


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINES = np.zeros(256, bool)
_NEWLINES[10] = True


def _line_counts(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and of these the ones equal to an earlier line of their row."""
    lines = X.words(p.data, p.at, _NEWLINES)
    words = np.concatenate([[0], np.cumsum(~X.SPACES[p.data])])
    full = np.flatnonzero(words[lines.ends] > words[lines.starts])
    row = np.searchsorted(lines.rows, full, side="right") - 1
    _, first = np.unique(X.mix(lines.hashes[full] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    count = np.bincount(row, minlength=p.n)
    return count, count - np.bincount(row[first], minlength=p.n)


def _repeat_words(p: Piece) -> tuple[np.ndarray]:
    """Words inside 3-word windows that the row has twice or more."""
    t = p.tokens
    windows = X.window_hashes(t.hashes, 3)
    covered = np.zeros(len(t.hashes) + 3, bool)
    for lo, hi in zip(t.rows[:-1], t.rows[1:], strict=True):
        if hi - lo > 3:
            own = windows[lo : hi - 2]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                again = np.unique(np.concatenate([order[1:][same], order[:-1][same]])) + lo
                covered[again] = covered[again + 1] = covered[again + 2] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    return (total[t.rows[1:]] - total[t.rows[:-1]],)


def _ends_with(p: Piece, mark: bytes) -> np.ndarray:
    """Per row, lines whose last bytes are ``mark``."""
    hit = np.ones(len(p.data), bool)
    for back, byte in enumerate(reversed(mark)):
        hit[back:] &= p.data[: len(p.data) - back] == byte
        # A row's first bytes aren't the end of a mark that began in the row before.
        early = p.at[:-1] + back - 1 if back else p.at[:0]
        hit[early[early < len(hit)]] = False
    last = np.zeros(len(p.data), bool)
    last[:-1] = p.data[1:] == 10
    last[p.at[1:][p.at[1:] > p.at[:-1]] - 1] = True
    return p.per_row(hit & last)


#: What works out which quantities: one step may give several.
STEPS: dict[tuple[str, ...], Callable[[Piece], tuple[np.ndarray, ...]]] = {
    ("n_words",): lambda p: (np.diff(p.tokens.rows),),
    ("word_chars",): lambda p: (p.per_row(~X.SPACES[p.data] & ((p.data & 0xC0) != 0x80)),),
    ("n_symbols",): lambda p: (p.per_row(_SYMBOLS[p.data]),),
    ("n_letters",): lambda p: (p.per_row(~X.NON_LETTERS[p.data] & ((p.data & 0xC0) != 0x80)),),
    ("n_lines", "n_dup_lines"): _line_counts,
    ("n_repeat_words",): _repeat_words,
    ("n_cut_lines",): lambda p: (_ends_with(p, b"...") + _ends_with(p, "\u2026".encode()),),
}
_STEP_OF = {name: step for step in STEPS for name in step}


class Measures:
    """Quantities of one piece's rows, each worked out for a row when first asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.piece = Piece(data, at)
        self.values: dict[str, np.ndarray] = {}
        self.known: dict[tuple[str, ...], np.ndarray] = {}
        #: How many rows each step has looked at.
        self.measured: Counter = Counter()

    def ask(self, name: str, rows: np.ndarray) -> np.ndarray:
        step = _STEP_OF[name]
        if step not in self.known:
            self.known[step] = np.zeros(self.piece.n, bool)
            self.values |= {x: np.zeros(self.piece.n, np.int64) for x in step}
        new = rows[~self.known[step][rows]]
        if len(new):
            for x, found in zip(step, STEPS[step](self.piece.of(new)), strict=True):
                self.values[x][new] = found
            self.known[step][new] = True
            self.measured[step] += len(new)
        return self.values[name][rows]

    def rejected(self, rule: Rule, rows: np.ndarray) -> np.ndarray:
        return rule.rejects(*[self.ask(x, rows) for x in rule.needs])


#: The base verdict: too few words, or too many inside repeated 3-word windows.
BASE = [
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
]

#: The method's further rules, after published quality filters for web text.
FURTHER = [
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c > 15 * n) | (2 * c < 3 * n)),
    Rule("letters", ("n_letters", "word_chars"), lambda x, c: 10 * x < 6 * c),
    Rule("cut_lines", ("n_cut_lines", "n_lines"), lambda x, n: 10 * x > 3 * n),
]

#: Quantities that the digest of every row has.
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plan(documents: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 500, given: tuple[str, ...] = ()) -> list[Rule]:
    """``rules`` in greedy order of rejections per second, on ``sample_rows`` random rows.

    Quantities ``given`` are worked out anyway, so they cost a rule nothing; nor do those of rules before it.
    Twice the share of rows that is needed is drawn where they lie, so the driver gets few, however many tasks read.
    """
    share = 2 * sample_rows / max(1, documents.count())
    chosen = documents.select(text, F.rand(17).alias("__at")).where(F.col("__at") < share).orderBy("__at").limit(sample_rows).select(text).collect()
    pieces = [(data, at) for _, _, data, at in X.pieces(pa.array([r[0] for r in chosen], pa.string()))]
    return greedy(pieces, rules, given)


def greedy(pieces: list[tuple[np.ndarray, np.ndarray]], rules: list[Rule], given: tuple[str, ...] = (), clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    done, ordered, left = [], [], list(rules)
    while left:
        scored = []
        for place, rule in enumerate(left):
            rejected, spent = 0, 1e-9
            for data, at in pieces:
                m = Measures(data, at)
                for x in given:
                    m.ask(x, np.arange(m.piece.n))
                alive = _alive(m, done, np.arange(m.piece.n))
                began = clock()
                rejected += int(m.rejected(rule, alive).sum()) if len(alive) else 0
                spent += clock() - began
            scored.append((-rejected / spent, spent, place))
        best = left.pop(min(scored)[2])
        done.append(best)
        ordered.append(best)
    return ordered


def _alive(m: Measures, rules: list[Rule], rows: np.ndarray) -> np.ndarray:
    """The rows that all rules keep; each looks at what those before it left."""
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~m.rejected(rule, rows)]
    return rows


def measure(documents: DataFrame, further: list[Rule] | None = None, key: str = "doc_id", text: str = "text", sample_rows: int = 500) -> DataFrame:
    """Per row: key, the counts, base_failed and kept.

    Null and empty texts have no words, so the base verdict fails them. Null keys and repeated rows
    pass through, one row each; an empty table gives none. Texts are read whole, in pieces of about
    1 MB that never cut a row. The counts are worked out for every row, as the result has them; further
    quantities only for rows that the base verdict and all earlier rules keep.
    """
    ordered = plan(documents, FURTHER if further is None else further, text, sample_rows, DIGEST)
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in DIGEST], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in X.pieces(batch.column(1)):
                m, every = Measures(data, at), np.arange(hi - lo)
                counts = [pa.array(m.ask(x, every), pa.int64()) for x in DIGEST]
                failed = np.ones(hi - lo, bool)
                failed[passed := _alive(m, BASE, every)] = False
                kept = np.zeros(hi - lo, bool)
                kept[_alive(m, ordered, passed)] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, pa.array(failed), pa.array(kept)], names=schema.names)

    return documents.select(key, text).mapInArrow(run, schema)


def without_rejected(documents: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """``documents`` without the rows that a rule rejects (``BASE`` and ``FURTHER`` by default).

    The whole cascade short-circuits here: no quantity is worked out for a row that an earlier rule rejects.
    Null and empty texts have no words; columns of any names, null keys and repeated rows pass through.
    """
    ordered = plan(documents, [*BASE, *FURTHER] if rules is None else rules, text, sample_rows)
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in X.pieces(batch.column(place)):
                yield batch.slice(lo, hi - lo).take(pa.array(_alive(Measures(data, at), ordered, np.arange(hi - lo))))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), m AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         length(regexp_replace(text, '[\x00-@\[-`{-\x7f]', '', 'g')) AS n_letters, ws,
         list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS n_cut_lines FROM w
), win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM m)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + o AS p FROM rep, (VALUES (0), (1), (2)) t(o)) GROUP BY r
), f AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, n_letters, n_cut_lines
  FROM m LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 15 * n_words
            OR 2 * word_chars < 3 * n_words OR 10 * n_letters < 6 * word_chars OR 10 * n_cut_lines > 3 * n_lines) AS kept FROM b
"""
