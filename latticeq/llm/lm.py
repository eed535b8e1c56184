"""Scores of a gated recurrent language model, in numpy.

A GRU reads words as slots of a bounded vocabulary (the most frequent training tokens, or "other"). Its
output softmax is factored by classes: the probability of a slot is that of its class times that inside
the class, so a step costs the square root of the vocabulary. "Other" is a class of its own, inside
which a token has its smoothed share of the training counts; these are over the whole vocabulary.

Training is truncated backpropagation over windows of lanes: a warm start on a bounded sample on the
driver, then one pass over all training documents, each task starting from the warm start; the tasks' models
are averaged by the tokens they saw. Scoring carries each document's state through all windows to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import stored

#: The end of a document as a token; no word's hash is meant by it.
END = np.uint64(0x5E0F_D0C5_0000_0001)
SLOTS, MEMBERS, HIDDEN = 4096, 64, 20
CLASSES = SLOTS // MEMBERS + 1
OTHER = SLOTS
#: Tokens whose counts are sent to all tasks; counts of the rest are joined.
HEAD = 1 << 19
BLOCK = 1 << 14
LOG10 = np.float32(1 / np.log(10))


def held_out(key: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Trace:
    """What a window's forward pass leaves for the backward one: (steps, units, lanes)."""

    def __init__(self, steps: int, lanes: int):
        self.h0, self.rh = np.empty((2, steps, HIDDEN, lanes), np.float32)
        self.gates: np.ndarray | None = None


def _softmax(logits: np.ndarray, pick: np.ndarray, grads: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's ``pick`` and, with ``grads``, the probabilities less one at the pick."""
    rows = np.arange(len(logits))
    if len(logits) and max(logits.max(), -logits.min()) > 60:
        logits -= logits.max(1, keepdims=True)
    out = logits[rows, pick]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    out -= np.log(total)
    if grads:
        logits *= (1 / total)[:, None]
        logits[rows, pick] -= 1
    return out, logits


class Gru:
    """Parameters, forward windows and one training step."""

    NAMES = ("e", "u", "wc", "bc", "ww", "bw")
    SHAPES = {"e": (SLOTS + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (CLASSES - 1, HIDDEN, MEMBERS), "bw": (CLASSES - 1, MEMBERS)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 7):
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.normal(0, 0.1, int(np.prod(s))) if n in ("e", "u", "wc", "ww") else np.zeros(int(np.prod(s)))) for n, s in self.SHAPES.items()])
        self.flat = np.array(flat, np.float32)
        at = 0
        for n, s in self.SHAPES.items():
            setattr(self, n, self.flat[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        self.seen: dict[str, np.ndarray] = {}

    def biased(self, counts: np.ndarray, other: float) -> Gru:
        """Output biases from training counts, so an untrained model starts as a unigram model."""
        c = np.zeros(SLOTS)
        c[: len(counts)] = counts
        by_class = np.append(c.reshape(-1, MEMBERS).sum(1), other) + 1
        self.bc[:] = np.log(by_class / by_class.sum())
        self.bw[:] = np.log(c + 0.5).reshape(-1, MEMBERS)
        return self

    def forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: Trace | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step of a window (steps, lanes); ``keep`` is 0 where a lane starts afresh.

        Inside, lanes are the last axis, so that gates are contiguous blocks; ``h`` is (lanes, units) outside.
        """
        n = HIDDEN
        a = np.ascontiguousarray(self.e[x].transpose(0, 2, 1))
        out = np.empty((len(x), n, x.shape[1]), np.float32)
        ug, uc = np.ascontiguousarray(self.u[:, : 2 * n].T), np.ascontiguousarray(self.u[:, 2 * n :].T)
        h = np.ascontiguousarray(h.T)
        for t in range(len(x)):
            h0 = h * keep[t]
            g = a[t, : 2 * n]
            g += ug @ h0
            np.negative(g, out=g)
            with np.errstate(over="ignore"):
                np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            rh = g[n:] * h0
            c = a[t, 2 * n :]
            c += uc @ rh
            np.tanh(c, out=c)
            h = out[t]
            np.subtract(c, h0, out=h)
            h *= g[:n]
            h += h0
            if trace is not None:
                trace.h0[t], trace.rh[t] = h0, rh
        if trace is not None:
            trace.gates = a
        return np.ascontiguousarray(out.transpose(0, 2, 1)), h.T

    def log_probs(self, states: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log probability of slots ``y`` after ``states``; with ``grads`` also their gradients."""
        k = np.minimum(y // MEMBERS, CLASSES - 1)
        order = np.argsort(k, kind="stable")
        cuts = np.searchsorted(k[order], np.arange(CLASSES))
        k, s = k[order], np.ones((len(y), HIDDEN + 1), np.float32)
        s[:, :HIDDEN] = states[order]
        wc = np.concatenate([self.wc, self.bc[None]])
        value, p = _softmax(s @ wc, k, grads is not None)
        # All rows of a class stand together: one product for each class, everything else at once.
        some, member = cuts[-1], y[order][: cuts[-1]] % MEMBERS
        ww = np.concatenate([self.ww, self.bw[:, None]], 1)
        inner = np.empty((some, MEMBERS), np.float32)
        full = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES - 1) if cuts[c] < cuts[c + 1]]
        for c, own in full:
            np.matmul(s[own], ww[c], out=inner[own])
        more, q = _softmax(inner, member, grads is not None)
        value[:some] += more
        out = np.empty(len(y), np.float32)
        out[order] = value
        if grads is not None:
            both = s.T @ p
            grads["wc"], grads["bc"] = both[:HIDDEN], both[HIDDEN]
            dh = p @ self.wc.T
            both = np.zeros_like(ww)
            for c, own in full:
                np.matmul(s[own].T, q[own], out=both[c])
                dh[own] += q[own] @ self.ww[c].T
            grads["ww"], grads["bw"] = both[:, :HIDDEN], both[:, HIDDEN]
            grads["h"] = np.empty_like(dh)
            grads["h"][order] = dh
        return out

    def _update(self, name: str, at: np.ndarray | slice, grad: np.ndarray, rate: float) -> None:
        """Adagrad."""
        if name not in self.seen:
            self.seen[name] = np.full_like(getattr(self, name), 1e-6)
        seen = self.seen[name][at] + grad * grad
        self.seen[name][at] = seen
        getattr(self, name)[at] -= rate * grad / np.sqrt(seen)

    def step(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray, rate: float) -> tuple[float, np.ndarray]:
        """One window of truncated backpropagation and an Adagrad update; mean log probability, last state."""
        n, trace = HIDDEN, Trace(*x.shape)
        states, last = self.forward(x, keep, h, trace)
        grads: dict = {}
        lp = self.log_probs(states.reshape(-1, n), y.reshape(-1), grads)
        scale = np.float32(1 / len(lp))
        dh_out = np.ascontiguousarray(grads.pop("h").reshape(*x.shape, n).transpose(0, 2, 1))
        ug, uc = np.ascontiguousarray(self.u[:, : 2 * n]), np.ascontiguousarray(self.u[:, 2 * n :])
        da = np.empty_like(trace.gates)
        dh = np.zeros((n, x.shape[1]), np.float32)
        gates, ends = trace.gates, 1 - trace.gates[:, : 2 * n]
        ends *= gates[:, : 2 * n]
        for t in range(len(x) - 1, -1, -1):
            z, r, c = gates[t, :n], gates[t, n : 2 * n], gates[t, 2 * n :]
            dh += dh_out[t]
            dc = da[t, 2 * n :]
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= z
            dc *= dh
            drh = uc @ dc
            dg = da[t, : 2 * n]
            np.subtract(c, trace.h0[t], out=dg[:n])
            dg[:n] *= dh
            np.multiply(drh, trace.h0[t], out=dg[n:])
            dg *= ends[t]
            drh *= r
            dh *= 1 - z
            dh += drh
            dh += ug @ dg
            dh *= keep[t]
        da = np.ascontiguousarray(da.transpose(0, 2, 1)).reshape(-1, 3 * n)
        flat = lambda v: v.transpose(1, 0, 2).reshape(n, -1)
        grads["u"] = np.concatenate([flat(trace.h0) @ da[:, : 2 * n], flat(trace.rh) @ da[:, 2 * n :]], 1)
        for name, grad in grads.items():
            self._update(name, slice(None), np.clip(grad * scale, -1, 1), rate)
        order = np.argsort(x.reshape(-1), kind="stable")
        slots, first = np.unique(x.reshape(-1)[order], return_index=True)
        self._update("e", slots, np.add.reduceat(da[order], first, axis=0) * scale, rate)
        return float(lp.mean()), last

    def learn(self, stream: np.ndarray, end: int, lanes: int, steps: int = 20, rate: float = 0.05) -> float:
        """One pass over a stream of slots, documents ended by ``end``, cut into lanes; mean log probability."""
        lanes = max(1, min(lanes, len(stream) // steps))
        length, more = divmod(len(stream), lanes)
        if not len(stream):
            return 0.0
        # The first lanes have a token more, so that all are learnt: a last row is of those lanes only, and its
        # update is as much smaller as the row is narrower.
        starts = np.arange(lanes) * length + np.minimum(np.arange(lanes), more)
        place = starts + np.arange(length)[:, None]
        before = np.concatenate([[end], stream[:-1]])
        h, total = np.zeros((lanes, HIDDEN), np.float32), 0.0

        def window(at: np.ndarray, h: np.ndarray, first: bool) -> np.ndarray:
            nonlocal total
            keep = (before[at] != end).astype(np.float32)
            if first:
                keep[0] = 0
            lp, h = self.step(before[at], stream[at], keep, h, rate * min(1.0, at.size / lanes))
            total += lp * at.size
            return h

        for t in range(0, length, steps):
            h = window(place[t : t + steps], h, t == 0)
        if more:
            window((starts[:more] + length)[None], h[:more], False)
        return total / len(stream)

    def score(self, documents: list[np.ndarray], end: int, lanes: int = 192, steps: int = 32) -> np.ndarray:
        """Log10 probability of the slots of each document, state carried from its start to its end.

        Documents are packed whole into lanes of about equal length, the longest first.
        """
        sizes = np.array([len(d) for d in documents], np.int64)
        lanes = max(1, min(lanes, len(documents)))
        order = np.argsort(-sizes, kind="stable")
        most = max(int(sizes.max(initial=0)), -(-int(sizes.sum()) // lanes))
        filled = [[] for _ in range(lanes)]
        room = np.full(lanes, most)
        place = 0
        for d in order:
            if room[place] < sizes[d]:
                place = int(np.argmax(room))
            filled[place].append(d)
            room[place] -= sizes[d]
            place = (place + 1) % lanes
        length = int((most - room).max(initial=0))
        y = np.full((lanes, length), OTHER, np.int32)
        owner = np.full((lanes, length), -1, np.int64)
        fresh = np.zeros((lanes, length), bool)
        for lane, own in enumerate(filled):
            at = 0
            for d in own:
                y[lane, at : at + sizes[d]] = documents[d]
                owner[lane, at : at + sizes[d]] = d
                fresh[lane, at : at + 1] = True
                at += sizes[d]
        # Lanes by falling length: a window has those only that still hold tokens.
        ends = most - room
        lane = np.argsort(-ends, kind="stable")
        ends, y, owner, keep = ends[lane], y[lane].T, owner[lane].T, (~fresh[lane].T).astype(np.float32)
        before = np.concatenate([np.full((1, lanes), end, np.int32), y[:-1]])
        before = np.where(keep == 0, end, before)
        h, out = np.zeros((lanes, HIDDEN), np.float32), np.zeros(len(documents))
        for t in range(0, length, steps):
            n = int(np.searchsorted(-ends, -t, side="left"))
            states, h = self.forward(before[t : t + steps, :n], keep[t : t + steps, :n], h[:n])
            own = owner[t : t + steps, :n].reshape(-1)
            real = np.flatnonzero(own >= 0)
            lp = self.log_probs(states.reshape(-1, HIDDEN)[real], y[t : t + steps, :n].reshape(-1)[real])
            out += np.bincount(own[real], weights=lp * LOG10, minlength=len(documents))
        return out


@dataclass
class Vocabulary:
    """Head tokens' hashes in order, with counts and slots; the totals of all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    slots: np.ndarray
    n: int
    v: int

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, n: int, v: int) -> Vocabulary:
        rank = np.lexsort((hashes, -counts))
        slots = np.full(len(hashes), OTHER, np.int32)
        slots[rank[:SLOTS]] = np.arange(min(SLOTS, len(rank)))
        order = np.argsort(hashes)
        return cls(hashes[order], counts[order], slots[order], n, v)

    @property
    def slot_counts(self) -> np.ndarray:
        own = self.slots < OTHER
        out = np.zeros(int(own.sum()), np.int64)
        out[self.slots[own]] = self.counts[own]
        return out

    @property
    def end(self) -> int:
        at = np.searchsorted(self.hashes, END)
        return int(self.slots[at]) if at < len(self.hashes) and self.hashes[at] == END else OTHER

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head (0 where absent), and whether each is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a column: row range, hashes of all tokens with ends, and each row's range of them."""
    for lo, hi, data, at in X.pieces(column):
        w = X.words(data, at, codes=X.FOLDED_CODES)
        n = hi - lo
        rows = w.rows + np.arange(n + 1)
        out = np.full(len(w.hashes) + n, END, np.uint64)
        word = np.ones(len(out), bool)
        word[rows[1:] - 1] = False
        out[word] = w.hashes
        yield lo, hi, out, rows


def token_counts(documents: DataFrame, text: str) -> DataFrame:
    """h (token hash), c (its count over all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            return own, np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(own)).astype(np.int64)

        def sent() -> pa.RecordBatch:
            own, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(c)], names=["h", "c"])

        for batch in batches:
            for _, _, hashes, _ in _tokens(batch.column(0)):
                parts.append(np.unique(hashes, return_counts=True))
                size += len(parts[-1][0])
                if size > 3_000_000:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > 2_000_000:
                        yield sent()
                        parts, size = [], 0
        if parts:
            yield sent()

    return documents.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head: all tokens whose count reaches the least for which at most HEAD tokens do."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bins = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("c", "descending")])
    c, many = bins.column("c").to_numpy(), np.cumsum(bins.column("n").to_numpy())
    fit = int(np.searchsorted(many, HEAD, side="right"))
    least = int(c[fit - 1]) if fit else 1 << 62
    head = counts.where(F.col("c") >= least).toArrow()
    return Vocabulary.of(head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy(), int(n), int(v))


def train(documents: DataFrame, words: Vocabulary, text: str = "text", key: str = "doc_id", warm_rows: int = 1000, warm_passes: int = 4) -> Gru:
    """The averaged model. ``warm_rows`` bounds the warm start's sample; the pass after it has all rows."""
    spark = documents.sparkSession
    known = words.slot_counts
    end = words.end
    ends = known[end] if end < len(known) else 0
    model = Gru().biased(known, words.n - known.sum())
    if not words.n:
        return model
    shared = spark.sparkContext.broadcast(words)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, rows in _tokens(batch.column(0)):
                at, there = shared.value.look(hashes)
                own = np.where(there, shared.value.slots[at], OTHER).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(own))], names=["s"])

    share = min(1.0, warm_rows / max(1, ends))
    order = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit("warm")), F.lit(1_000_000))
    warm = documents.where(order < int(share * 1_000_000) + 1).select(text).limit(2 * warm_rows).mapInArrow(slots, "s array<int>").toArrow()
    stream = warm.column("s").combine_chunks().flatten().to_numpy() if warm.num_rows else np.zeros(0, np.int32)
    for _ in range(warm_passes):
        model.learn(stream, end, 64)
    start = spark.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, seen = Gru(start.value), [], 0, 0
        for batch in batches:
            for _, _, hashes, _ in _tokens(batch.column(0)):
                at, there = shared.value.look(hashes)
                held.append(np.where(there, shared.value.slots[at], OTHER).astype(np.int32))
                size += len(hashes)
                if size >= 1_000_000:
                    own.learn(np.concatenate(held), end, 256)
                    held, seen, size = [], seen + size, 0
        if size:
            own.learn(np.concatenate(held), end, 256)
            seen += size
        if seen:
            flat = own.flat.astype(np.float64)
            cuts = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([float(seen)] * len(cuts)), pa.array([flat[i : i + BLOCK] for i in cuts], pa.list_(pa.float64()))], names=["b", "w", "p"])

    parts = documents.select(text).mapInArrow(run, "b int, w double, p array<double>")
    mean = parts.groupBy("b").agg(Summarizer.mean(array_to_vector("p"), F.col("w")).alias("p")).select("b", vector_to_array("p").alias("p"))
    found = mean.toArrow().sort_by("b")
    return Gru(found.column("p").combine_chunks().flatten().to_numpy()) if found.num_rows else model


def language_scores(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from rows whose crc32 of the key as text, mod 7, isn't 2 (a null key counts as empty text). Null
    and empty texts are a single end token. Repeated rows are learnt from and scored as often as they
    stand. Without training rows the model is the untrained one and all counts are 0. Texts are whole.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), held_out(key).alias("held"))
    training = rows.where(~F.col("held"))
    counts = stored(token_counts(training, "text"), "counts")
    words = vocabulary(counts)
    model = spark.sparkContext.broadcast(train(training, words, "text", "id").flat)
    shared = spark.sparkContext.broadcast(words)
    schema = T.StructType([T.StructField("id", documents.schema[key].dataType), T.StructField("held", T.BooleanType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n", "n_known", "n_other")], *[T.StructField(c, T.DoubleType()) for c in ("all_sum", "other_sum", "slots_score")], T.StructField("tail", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gru, end = shared.value, Gru(model.value), shared.value.end
        logs = np.log10(own.counts + 1.0)
        base, number = TaskContext.get().partitionId() << 40, 0
        held: list[dict] = []
        slots: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal held, slots, size
            for row, score in zip(held, gru.score(slots, end), strict=True):
                row["slots_score"] = float(score)
            tails = [r.pop("tail") for r in held]
            cuts = np.concatenate([[0], np.cumsum([len(h) for h, _ in tails])])
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([h for h, _ in tails]).view(np.int64)), pa.array(np.concatenate([k for _, k in tails]).astype(np.int32))], names=["h", "k"])
            plain = [pa.array([r[c] for r in held], t) for c, t in types.items()]
            out = pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)], names=[*types, "tail"])
            held, slots, size = [], [], 0
            return out

        for batch in batches:
            types = {"id": batch.schema.field(0).type, "held": pa.bool_(), "row": pa.int64(), "n": pa.int64(), "n_known": pa.int64(), "n_other": pa.int64(), "all_sum": pa.float64(), "other_sum": pa.float64(), "slots_score": pa.float64()}
            for lo, hi, hashes, bounds in _tokens(batch.column(1)):
                at, there = own.look(hashes)
                slot = np.where(there, own.slots[at], OTHER).astype(np.int32) if len(own.hashes) else np.full(len(hashes), OTHER, np.int32)
                log = np.where(there, logs[at], 0.0) if len(own.hashes) else np.zeros(len(hashes))
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    other = slot[a:b] == OTHER
                    held.append({"id": batch.column(0)[lo + i].as_py(), "held": batch.column(2)[lo + i].as_py(), "row": base + number, "n": int(b - a), "n_known": int(there[a:b].sum()), "n_other": int(other.sum()), "all_sum": float(log[a:b].sum()), "other_sum": float(log[a:b][other].sum()), "tail": np.unique(hashes[a:b][~there[a:b]], return_counts=True)})
                    slots.append(slot[a:b])
                    number += 1
                    size += int(b - a)
                if size >= 4_000_000:
                    yield sent()
        if held:
            yield sent()

    scored = stored(rows.select("id", "text", "held").mapInArrow(run, schema), "scores")
    rare = scored.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.k")
    rare = rare.join(counts, "h").groupBy("row").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("tail_sum"))
    known = int(words.slot_counts.sum())
    all_log = float(np.log10(words.n + words.v + 1.0))
    other_log = float(np.log10(words.n - known + words.v - len(words.slot_counts) + 1.0))
    tail = F.coalesce("tail_sum", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("all_sum") + tail - F.col("n") * all_log).alias("base_score"), (F.col("slots_score") + F.col("other_sum") + tail - F.col("n_other") * other_log).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
