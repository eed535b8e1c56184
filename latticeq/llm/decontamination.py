"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items hide in long documents, so their Jaccard similarity says nothing; what counts is
containment, the share of an item's shingles that a document has. Items are partitioned by size.
A partition has its own hash threshold, so that each of its items retains about ``keep`` of its
shingle hashes (all, if it has no more) as its MinHash sketch, while a document's retained hashes for
that partition are those under the same threshold: a sample whose containment estimates the whole's
whatever the document's length. Pairs that reach the estimate, less six standard deviations, are
verified by the exact containment of all their shingles, by 64-bit hashes of the whole shingle sets.

The index holds items only, as hashes, in blocks of so many bytes, each broadcast and searched against all
documents: the number of blocks grows with the benchmark, their size doesn't. The benchmark is read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import text as X


@dataclass
class Index:
    """A block of items: sketches as retained values in order, with postings; whole sets; items of few words.

    Item i's set is ``sets[cuts[i] : cuts[i + 1]]``, sorted. ``short`` has, by number of words, the hashes
    of items that are shorter than a shingle, in order, and which items they are.
    """

    ids: list
    sets: np.ndarray
    cuts: np.ndarray
    bits: np.ndarray
    values: np.ndarray
    offsets: np.ndarray
    items: np.ndarray
    least: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build(rows: list[tuple[object, int, np.ndarray]], size: int, share: float, keep: int) -> Index:
    """The index of (id, words, sorted shingle hashes); an item of fewer than ``size`` words has one shingle."""
    least, kept = [], []
    for _, words, hashes in rows:
        if words < size:
            kept.append(hashes[:0])
            least.append(math.inf)
            continue
        # The size partition: a power of two; its threshold keeps 1 in 2^level of all hashes.
        level = max(0, math.ceil(math.log2(len(hashes) / keep)))
        mine = hashes[hashes >> np.uint64(64 - level) == 0] if level else hashes
        if len(mine) < keep // 4:
            mine = hashes
        slack = 6 * math.sqrt(share * (1 - share) * len(mine)) if len(mine) < len(hashes) else 0
        least.append(max(1, math.ceil(share * len(mine) - slack - 1e-9)))
        kept.append(mine)
    none = np.zeros(0, np.uint64)
    values, owner = np.concatenate([none, *kept]), np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in kept])
    order = np.argsort(values, kind="stable")
    own, first = np.unique(values[order], return_index=True)
    bits = np.zeros(1 << min(24, max(16, (16 * len(own)).bit_length())), bool)
    bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    short = {}
    for n in {words for _, words, _ in rows if words < size}:
        which = np.array([i for i, (_, words, _) in enumerate(rows) if words == n])
        hashes = np.array([rows[i][2][0] for i in which], np.uint64)
        order_n = np.argsort(hashes, kind="stable")
        short[n] = hashes[order_n], which[order_n]
    sets = [x for _, _, x in rows]
    return Index([i for i, _, _ in rows], np.concatenate([none, *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64), bits, own, np.append(first, len(values)), owner[order], np.array(least), short)


def search(index: Index, hashes: np.ndarray) -> list[int]:
    """Items of which enough retained values are among a document's shingle hashes (any order, repeats)."""
    maybe = hashes[index.bits[(hashes & np.uint64(len(index.bits) - 1)).astype(np.int64)]]
    if not len(maybe) or not len(index.values):
        return []
    maybe = np.unique(maybe)
    at = np.searchsorted(index.values, maybe)
    at = at[(at < len(index.values)) & (index.values[np.minimum(at, len(index.values) - 1)] == maybe)]
    if not len(at):
        return []
    found, count = np.unique(np.concatenate([index.items[index.offsets[i] : index.offsets[i + 1]] for i in at]), return_counts=True)
    return [int(i) for i, c in zip(found, count, strict=True) if c >= index.least[i]]


def _short_hits(index: Index, tokens: X.Words) -> dict[int, set[int]]:
    """By row, the items of few words that stand in it as a run of words."""
    out: dict[int, set[int]] = {}
    for n, (hashes, which) in index.short.items():
        every = X.window_hashes(tokens.hashes, n)
        lo, hi = np.searchsorted(hashes, every), np.searchsorted(hashes, every, side="right")
        for at in np.flatnonzero(hi > lo):
            row = int(np.searchsorted(tokens.rows, at, side="right")) - 1
            if at + n <= tokens.rows[row + 1]:
                out.setdefault(row, set()).update(which[lo[at] : hi[at]].tolist())
    return out


def matches(column: pa.Array, index: Index, size: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) for every item of the index that a text contains."""
    for lo, _, data, at in X.pieces(column):
        tokens = X.words(data, at, codes=X.FOLDED_CODES)
        every = X.window_hashes(tokens.hashes, size)
        hit = np.zeros(len(tokens.hashes) + 1, bool)
        hit[: len(every)] = index.bits[(every & np.uint64(len(index.bits) - 1)).astype(np.int64)]
        hits = np.concatenate([[0], np.cumsum(hit)])
        for row, items in _short_hits(index, tokens).items():
            yield from ((lo + row, x, 1) for x in sorted(items))
        for i, (a, b) in enumerate(zip(tokens.rows[:-1], tokens.rows[1:], strict=True), lo):
            last = max(a, b - size + 1)
            near = search(index, every[a:last]) if hits[last] > hits[a] else []
            if near:
                own = np.unique(every[a:last])
                for x in near:
                    mine = index.sets[index.cuts[x] : index.cuts[x + 1]]
                    same = len(np.intersect1d(mine, own, assume_unique=True))
                    if 100 * same >= percent * len(mine):
                        yield i, x, same


def blocks_of(benchmark: DataFrame, item: str, text: str, size: int, percent: int, keep: int, block_bytes: int) -> Iterator[Index]:
    """The benchmark's items in blocks of some ``block_bytes``, one at least; each is all that is held at a time."""
    items = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").distinct()
    rows: list[tuple[object, int, np.ndarray]] = []
    held, made = 0, 0
    for item_id, t in items.toLocalIterator():
        data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        tokens = X.words(data, np.array([0, len(data)]), codes=X.FOLDED_CODES)
        if not len(tokens.hashes):
            continue
        rows.append((item_id, len(tokens.hashes), next(X.shingle_sets(tokens, size))))
        # A hash in the set, and one with its posting among the retained values.
        held += 64 + 8 * len(rows[-1][2]) + 12 * min(2 * keep, len(rows[-1][2]))
        if held >= block_bytes:
            yield build(rows, size, percent / 100, keep)
            rows, held, made = [], 0, made + 1
    if rows or not made:
        yield build(rows, size, percent / 100, keep)


def contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, keep: int = 64, block_bytes: int = 1 << 26, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs with 100 * shared shingles >= ``percent`` * item shingles: key, item, n_item, n_shared.

    One row for each document row and item. Shingles are runs of ``size`` words, A-Z folded, of whole
    texts. An item of fewer words is one shingle, and is contained where its words stand in a row in the
    document. Null or empty texts and items contain nothing and are contained in nothing; null ids pass
    through; repeated documents give repeated rows, repeated items (same id and text) count once.
    """
    spark = documents.sparkSession
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())])
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for index in blocks_of(benchmark, item, item_text, size, percent, keep, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: Index = shared.value
            for batch in batches:
                if found := list(matches(batch.column(1), own, size, percent)):
                    rows, items, both = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([own.ids[x] for x in items], item_type), pa.array([int(own.cuts[x + 1] - own.cuts[x]) for x in items], pa.int64()), pa.array(both, pa.int64())], names=schema.names)

        part = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, keep: int = 64, block_bytes: int = 1 << 26, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` without the rows that contain an item, in the sense of ``contaminated``; no shuffle."""
    spark, at = documents.sparkSession, documents.columns.index(text)
    for index in blocks_of(benchmark, item, item_text, size, percent, keep, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, _, _ in matches(batch.column(at), shared.value, size, percent)]] = False
                yield batch.filter(pa.array(clean))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t
), s AS (
  SELECT DISTINCT kind, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS g
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id
), p AS (
  SELECT x.id AS doc_id, y.id AS item_id, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.kind = 0 AND y.kind = 1 GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(c AS BIGINT) AS n_shared FROM p JOIN n ON n.id = item_id WHERE 100 * c >= 80 * n
"""
