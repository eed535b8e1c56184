"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; the probability of each earlier category is a feature of
the later models. While training, those come from models fitted without the row at hand (out-of-fold
predictions): neither its weights nor its choice of features has seen the row's label, so a later model
learns from earlier probabilities as uncertain as it will meet, and the threshold is set on honest ones.

Features are words and word beginnings, hashed. Counts of documents by class and fold, over a bounded sample
of labelled rows, select those that tell the classes apart; the models are fitted on the driver over the
selected features of that sample, which are held once, in small types, whatever the number of folds.
Scoring is one pass over all documents, without a shuffle.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import discard, stored

#: Bytes of the word beginnings that are features besides whole words.
PREFIXES = (6, 7, 8, 9, 10)
FOLDS = 4
LEAST_Z = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0)
_MASK = (1 << 20) - 1


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of all words, then of each length of beginnings; letters lose their case."""
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    if len(upper):
        data = data.copy()
        data[upper] += 0x20
    t = X.words(data, at, X.NON_LETTERS, X.FOLDED_CODES, running=True)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(t.rows))
    yield rows, t.hashes
    if len(rows):
        for n in PREFIXES:
            # Hashes depend on where a beginning stands unless its terms start from the first power.
            hashes, which = t.prefix_hashes(n)
            yield rows[which], hashes


def _feature_counts(sample: DataFrame, categories: list[str]) -> DataFrame:
    """f, and for each category c and fold k: n{c}{k} labelled rows that have the feature, p{c}{k} of them positive."""
    k = len(categories)
    names = [f"{x}{c}{h}" for x in "np" for c in range(k) for h in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            labels = [batch.column(2 + c).fill_null(-1).to_numpy(zero_copy_only=False) for c in range(k)]
            hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, _, data, at in X.pieces(batch.column(0)):
                rows, found = (np.concatenate(x) for x in zip(*_features(data, at), strict=True))
                # One entry for each feature of a row.
                _, first = np.unique(X.mix(found + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                hashes.append(found[first])
                owners.append(rows[first] + lo)
            own, where = np.unique(np.concatenate(hashes), return_inverse=True)
            owner = np.concatenate(owners)
            cell = where * FOLDS + fold[owner]
            count = lambda flags: np.bincount(cell, weights=flags[owner], minlength=len(own) * FOLDS).astype(np.int32).reshape(-1, FOLDS).T
            columns = [x for c in range(k) for x in count(labels[c] >= 0)] + [x for c in range(k) for x in count(labels[c] == 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *[pa.array(x) for x in columns]], names=["f", *names])

    counts = sample.select("text", "fold", *categories).mapInArrow(run, ", ".join(["f long", *[f"{c} int" for c in names]]))
    return counts.groupBy("f").agg(*[F.sum(c).alias(c) for c in names])


def selected(sample: DataFrame, categories: list[str], most: int, least_rows: int = 4, most_false: float = 0.2) -> list[np.ndarray]:
    """Sorted feature hashes, for each fold as chosen without its labels, then as chosen from all.

    Each holds the ``most`` features of a category with the largest z, the root of the likelihood ratio of
    class and feature (a feature of few rows, all of one class, tells more than a common one with a leaning).
    The bound on z is the least of ``LEAST_Z`` over which at most a share ``most_false`` is due to chance, by
    the number of all features: more features without any bearing ask for a higher one.
    """
    k = len(categories)
    by_fold = sample.groupBy("fold").agg(*[F.count(F.col(c)).cast("long") for c in categories], *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)) for c in categories]).collect()
    totals = np.zeros((FOLDS, 2 * k), np.int64)
    for r in by_fold:
        totals[r[0]] = r[1:]
    wanted = []
    for held in range(FOLDS + 1):
        used = [h for h in range(FOLDS) if h != held]
        wanted += [(held, c, used, int(totals[used, c].sum()), int(totals[used, k + c].sum())) for c in range(k)]
    wanted = [w for w in wanted if 0 < w[-1] < w[-2]]
    found: list[list[int]] = [[] for _ in range(FOLDS + 1)]
    if wanted:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda x, c, used, batch=batch: sum(batch.column(f"{x}{c}{h}").to_numpy() for h in used).astype(float)
                scores = [np.where((n := get("n", c, used)) >= least_rows, _ratio(n, get("p", c, used), rows, pos), -1.0) for _, c, used, rows, pos in wanted]
                yield pa.RecordBatch.from_arrays([batch.column("f"), *map(pa.array, scores)], names=["f", *[f"z{i}" for i in range(len(wanted))]])

        scored = stored(_feature_counts(sample, categories).mapInArrow(run, ", ".join(["f long", *[f"z{i} double" for i in range(len(wanted))]])), "features")
        over = scored.agg(*[F.count(F.when(F.col(f"z{i}") > x, 1)) for i in range(len(wanted)) for x in (-0.5, *LEAST_Z)]).first()
        tops = []
        for i, (held, *_) in enumerate(wanted):
            every, *many = over[i * (1 + len(LEAST_Z)) : (i + 1) * (1 + len(LEAST_Z))]
            bound = next((x for x, n in zip(LEAST_Z, many, strict=True) if every * math.erfc(x / math.sqrt(2)) <= most_false * n), LEAST_Z[-1])
            tops.append(scored.select(F.lit(held).alias("held"), "f", F.col(f"z{i}").alias("z")).where(F.col("z") > bound).orderBy(F.desc("z"), "f").limit(most))
        for held, f, _ in reduce(DataFrame.union, tops).collect():
            found[held].append(f)
        discard(scored)
    return [np.unique(np.array(x, np.int64).view(np.uint64)) for x in found]


def _ratio(n: np.ndarray, p: np.ndarray, rows: int, pos: int) -> np.ndarray:
    """The root of the likelihood ratio of features that ``n`` of ``rows`` rows have, ``p`` of them positive."""
    total = np.zeros(len(n))
    for seen, due in ((p, pos * n), (n - p, (rows - pos) * n), (pos - p, pos * (rows - n)), (rows - pos - n + p, (rows - pos) * (rows - n))):
        total += seen * np.log(np.maximum(seen, 1) * rows / np.maximum(due, 1))
    return np.sqrt(np.maximum(2 * total, 0))


def _counted(column: pa.Array, vocabulary: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: its row range, (row, feature, count) of what its rows have of the vocabulary, rows' words."""
    for lo, hi, data, at in X.pieces(column):
        keys, words = [], np.ones(hi - lo, np.int64)
        for j, (rows, hashes) in enumerate(_features(data, at)):
            if not j:
                words = np.maximum(1, np.bincount(rows, minlength=hi - lo))
            if len(vocabulary):
                maybe = np.flatnonzero(bits[(hashes & np.uint64(_MASK)).astype(np.int64)])
                place = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
                good = vocabulary[place] == hashes[maybe]
                keys.append(rows[maybe[good]] * len(vocabulary) + place[good])
        key, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        row, feature = (key // len(vocabulary), key % len(vocabulary)) if len(vocabulary) else (key, key)
        yield lo, hi, row, feature, count, words


def _hits(column: pa.Array, vocabulary: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: its row range, and (row, feature, value) of what its rows have of the vocabulary.

    Feature f has two values: the logarithm of its count at 2f, its density at 2f + 1.
    """
    for lo, hi, row, feature, count, words in _counted(column, vocabulary, bits):
        values = np.concatenate([np.log1p(count), _density(count, words[row])])
        yield lo, hi, np.concatenate([row, row]), np.concatenate([2 * feature, 2 * feature + 1]), values


def _density(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.minimum(3.0, 50 * count / words)


def _bits(vocabulary: np.ndarray) -> np.ndarray:
    bits = np.zeros(_MASK + 1, bool)
    bits[(vocabulary & np.uint64(_MASK)).astype(np.int64)] = True
    return bits


def _row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, one for each of ``lengths``."""
    out = np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out


@dataclass
class Entries:
    """The sample's features: those of row i stand at ``cuts[i]`` to ``cuts[i + 1]``, with both their values."""

    cuts: np.ndarray
    feature: np.ndarray
    log: np.ndarray
    density: np.ndarray

    def dots(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted sums of some rows, with the entries used and the rows' numbers of them."""
        lengths = self.cuts[rows + 1] - self.cuts[rows]
        at = np.repeat(self.cuts[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        f = self.feature[at]
        return _row_sums(a[f] * self.log[at] + b[f] * self.density[at], lengths), at, lengths


@dataclass
class Linear:
    """Logistic regression over sparse rows, plus weights for earlier categories' probabilities."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_odds(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(row, weights=self.weights[feature] * value, minlength=n)[:n] + earlier @ self.earlier

    @classmethod
    def fit(cls, entries: Entries, rows: np.ndarray, allowed: np.ndarray, earlier: np.ndarray, label: np.ndarray, steps: int = 250, batch: int = 1024, rate: float = 0.05, decay: float = 3e-4) -> Linear:
        """Adam over batches of ``rows``, at a rate that falls to nothing, so that the last steps settle.

        ``allowed`` marks the features that may have weights; ``earlier`` and ``label`` are those of all rows. A
        category without both classes among ``rows`` gets its share as constant.
        """
        m, k = len(allowed), earlier.shape[1]
        pos = label[rows].mean() if len(rows) else 0.0
        out = cls(float(np.clip(np.log((pos + 1e-6) / (1 - pos + 1e-6)), -14, 14)), np.zeros(2 * m), np.zeros(k))
        if not 0 < pos < 1:
            return out
        theta = np.concatenate([[out.bias], np.zeros(k + 2 * m)])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        cut = 1 + k
        both = np.concatenate([np.ones(cut, bool), allowed, allowed])
        batch = min(batch, len(rows))
        for step in range(1, steps + 1):
            own = np.take(rows, np.arange((step - 1) * batch, step * batch), mode="wrap")
            z, at, lengths = entries.dots(own, theta[cut : cut + m], theta[cut + m :])
            z += theta[0] + earlier[own] @ theta[1:cut]
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[own]) / batch
            each, f = np.repeat(off, lengths), entries.feature[at]
            grad = np.concatenate([[off.sum()], off @ earlier[own], np.bincount(f, weights=each * entries.log[at], minlength=m), np.bincount(f, weights=each * entries.density[at], minlength=m)])
            grad[1:] += decay * theta[1:]
            grad *= both
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta = theta - rate * (1 - (step - 1) / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        out.bias, out.earlier = float(theta[0]), theta[1:cut]
        out.weights[0::2], out.weights[1::2] = theta[cut : cut + m], theta[cut + m :]
        return out


@dataclass
class Chain:
    categories: list[str]
    vocabulary: np.ndarray
    models: list[Linear]
    threshold: float

    def probabilities(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros((n, 0))
        for model in self.models:
            p = np.column_stack([p, _probability(model.log_odds(row, feature, value, n, p))])
        return p


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -8, 8)))


def labelled(documents: DataFrame, labels: DataFrame, categories: list[tuple[str, F.Column]], most_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text, fold and categories (0, 1 or null) of at most ``most_rows`` documents that have a label.

    Documents with a label of the last category come first, then those with the least hash of their id; so
    neither labels of absent documents nor lacking ones use up the bound. Null ids are left out; a repeated
    id counts once, with the greatest of its labels and of its texts.
    """
    names = [n for n, _ in categories]
    wanted = labels.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), *[e.cast("int").alias(n) for n, e in categories])
    wanted = wanted.groupBy("id").agg(*[F.max(n).alias(n) for n in names]).dropna("all", subset=names)
    wanted = wanted.join(documents.select(F.col(f"`{key}`").alias("id")), "id", "left_semi")
    # The broadcast side has most_rows rows of a few numbers at most.
    wanted = wanted.orderBy(F.col(names[-1]).isNull(), F.xxhash64("id"), "id").limit(most_rows)
    sample = documents.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
    sample = sample.groupBy("id").agg(F.max("text").alias("text"), *[F.first(n).alias(n) for n in names])
    return sample.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def entries_of(sample: DataFrame, names: list[str], vocabulary: np.ndarray) -> tuple[Entries, np.ndarray, np.ndarray]:
    """The sample on the driver, by hash of the id: its features, folds and labels (-1: none)."""
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bits = _bits(own)
        for batch in batches:
            for lo, hi, row, feature, count, words in _counted(batch.column(0), own, bits):
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (feature.astype(np.uint16), np.minimum(count, 65_535).astype(np.uint16))]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[1:]], pa.array(words), *[pa.array(x, pa.binary()) for x in packed]], names=["at", "fold", *names, "words", "f", "c"])

    columns = ["at long", "fold int", *[f"{n} int" for n in names], "words long", "f binary", "c binary"]
    quoted = [F.col(f"`{n}`") for n in names]
    found = sample.select("text", F.xxhash64("id", F.lit("order")).alias("at"), "fold", *quoted).mapInArrow(run, ", ".join(columns)).toArrow().sort_by("at")
    features, counts = ([np.frombuffer(x.as_py(), np.uint16) for x in found.column(c)] for c in "fc")
    words = found.column("words").to_numpy().astype(np.float32)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in features])]).astype(np.int64)
    count = np.concatenate([np.zeros(0, np.uint16), *counts]).astype(np.float32)
    entries = Entries(cuts, np.concatenate([np.zeros(0, np.uint16), *features]), np.log1p(count), _density(count, np.repeat(words, np.diff(cuts))).astype(np.float32))
    labels = np.stack([found.column(n).fill_null(-1).to_numpy() for n in names], 1).astype(np.int8)
    return entries, found.column("fold").to_numpy(), labels


def train(documents: DataFrame, labels: DataFrame, categories: list[tuple[str, F.Column]], most_rows: int = 20_000, most_features: int = 1500, least_precision: float = 0.7, key: str = "doc_id", text: str = "text") -> Chain:
    """A chain for ``categories`` (name, boolean expression over labels), the last of which is the verdict.

    ``labelled`` says which rows train it, at most ``most_rows``; a category is fitted on those that have its
    label, and predicted for all. The threshold is where out-of-fold predictions of the last category have
    the best F1 among those with ``least_precision``. Where none has it, as when texts don't explain the
    labels, the chain warns and rejects nothing.
    """
    names = [f"c{i}" for i in range(len(categories))]
    sample = stored(labelled(documents, labels, list(zip(names, [e for _, e in categories], strict=True)), most_rows, key, text), "labelled")
    chosen = selected(sample, names, most_features)
    # At most (folds + 1) times categories times most_features, so well under the 65 536 that two bytes tell apart.
    if (FOLDS + 1) * len(names) * most_features > 65_536:
        raise ValueError("too many features for the types that hold them")
    every = np.unique(np.concatenate(chosen))
    entries, fold, label = entries_of(sample, names, every)
    discard(sample)
    n, final = len(fold), np.searchsorted(every, chosen[-1])
    allowed = [np.isin(every, x) for x in chosen]
    models, held = [], np.zeros((n, 0))
    for c in range(len(names)):
        known, y = label[:, c] >= 0, (label[:, c] == 1).astype(float)
        out = np.zeros(n)
        for h in range(FOLDS):
            model = Linear.fit(entries, np.flatnonzero(known & (fold != h)), allowed[h], held, y)
            rest = np.flatnonzero(fold == h)
            out[rest] = model.bias + entries.dots(rest, model.weights[0::2], model.weights[1::2])[0] + held[rest] @ model.earlier
        model = Linear.fit(entries, np.flatnonzero(known), allowed[-1], held, y)
        models.append(Linear(model.bias, model.weights.reshape(-1, 2)[final].reshape(-1), model.earlier))
        held = np.column_stack([held, _probability(out)])
    threshold = best_threshold(out[known], y[known], least_precision) if n else None
    if threshold is None:
        warnings.warn(f"no threshold of {categories[-1][0]} reaches a precision of {least_precision}: nothing is rejected", stacklevel=2)
    return Chain([c for c, _ in categories], chosen[-1], models, 1.0 if threshold is None else threshold)


def best_threshold(odds: np.ndarray, label: np.ndarray, least_precision: float) -> float | None:
    """The probability of the best F1 among those with a precision; ties keep the highest. None: there is none."""
    order = np.argsort(-odds, kind="stable")
    odds, hit, n = np.clip(odds[order], -8, 8), np.cumsum(label[order]), np.arange(1, len(label) + 1)
    last = np.append(odds[1:] < odds[:-1], True) if len(odds) else np.zeros(0, bool)
    good = last & (hit > 0) & (hit >= least_precision * n)
    if not good.any():
        return None
    at = int(np.argmax(np.where(good, 2 * hit / (n + label.sum()), 0)))
    below = odds[at + 1] if at + 1 < len(odds) else odds[at]
    return float(1 / (1 + np.exp(-(odds[at] + below) / 2)))


def score(documents: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of ``keep`` (the key by default), a probability p_<category> each, and the verdict ``rejected``.

    Null and empty texts have no features: their probabilities are the models' biases. Repeated rows and
    null ids get a row each; an empty table gives none.
    """
    keep = keep or [key]
    fields = [documents.schema[c] for c in keep]
    names = [f"p_{c}" for c in chain.categories]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in names], T.StructField("rejected", T.BooleanType())])
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Chain = shared.value
        bits = _bits(own.vocabulary)
        for batch in batches:
            for lo, hi, row, feature, value in _hits(batch.column(0), own.vocabulary, bits):
                p = own.probabilities(row, feature, value, hi - lo)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[1:]], *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(p[:, -1] >= own.threshold if own.threshold < 1 else np.zeros(hi - lo, bool))], names=schema.names)

    return documents.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def without_rejected(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``documents`` without the rows that ``score`` rejects; columns of any names stay as they are.

    Null and empty texts have no features and stay unless the last model's bias alone rejects them; null ids
    and repeated rows are rows like others; an empty table stays empty.
    """
    at = documents.columns.index(text)
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Chain = shared.value
        bits = _bits(own.vocabulary)
        for batch in batches:
            for lo, hi, row, feature, value in _hits(batch.column(at), own.vocabulary, bits):
                p = own.probabilities(row, feature, value, hi - lo)[:, -1]
                yield batch.slice(lo, hi - lo).filter(pa.array((p < own.threshold) | (own.threshold >= 1)))

    return documents.mapInArrow(run, documents.schema)


def default_categories() -> list[tuple[str, F.Column]]:
    return [("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), default_categories())
    return score(documents, chain)
