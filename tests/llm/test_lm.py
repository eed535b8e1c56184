"""The language model: gradients, scores against step-by-step Python, base scores against counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from latticeq.llm import lm


def probability_of(model, slots, end):
    """Log10 probability by one step at a time, from the formulas."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, before, total, n = np.zeros(lm.HIDDEN), end, 0.0, lm.HIDDEN
    for y in slots:
        x = model.e[before].astype(float)
        z = sig(x[:n] + h @ model.u[:, :n])
        r = sig(x[n : 2 * n] + h @ model.u[:, n : 2 * n])
        c = np.tanh(x[2 * n :] + (r * h) @ model.u[:, 2 * n :])
        h = (1 - z) * h + z * c
        logits = h @ model.wc + model.bc
        p = np.exp(logits - logits.max())
        k = min(y // lm.MEMBERS, lm.CLASSES - 1)
        total += math.log10(p[k] / p.sum())
        if k < lm.CLASSES - 1:
            inner = h @ model.ww[k] + model.bw[k]
            q = np.exp(inner - inner.max())
            total += math.log10(q[y - k * lm.MEMBERS] / q.sum())
        before = y
    return total


def grown(seed=0):
    model = lm.Gru(seed=seed)
    model.flat += np.random.default_rng(seed).normal(0, 0.3, len(model.flat)).astype(np.float32)
    return model


def test_state_is_carried_through_whole_documents():
    rng = np.random.default_rng(1)
    model, end = grown(), 5
    documents = [np.append(rng.integers(0, lm.SLOTS + 1, n), end).astype(np.int32) for n in (0, 1, 3, 31, 32, 33, 500, 7, 90)]
    for lanes, steps in ((192, 32), (2, 5), (1, 1)):
        got = model.score(documents, end, lanes, steps)
        assert got == pytest.approx([probability_of(model, d, end) for d in documents], rel=1e-4)


def test_every_token_is_learnt_once(monkeypatch):
    rng, end, seen = np.random.default_rng(4), 5, Counter()
    step = lm.Gru.step

    def watched(self, x, y, *rest):
        seen.update(zip(x.ravel().tolist(), y.ravel().tolist(), strict=True))
        return step(self, x, y, *rest)

    monkeypatch.setattr(lm.Gru, "step", watched)
    for n in (0, 1, 19, 5119, 7000, 5120):
        stream = rng.integers(0, lm.SLOTS + 1, n).astype(np.int32)
        seen.clear()
        found = lm.Gru().learn(stream, end, 256)
        assert seen == Counter(zip([end, *stream[:-1].tolist()], stream.tolist(), strict=False)) and math.isfinite(found)


def test_probabilities_add_up_to_one():
    model = grown(3)
    states = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = model.log_probs(np.repeat(states, lm.SLOTS + 1, 0), np.arange(lm.SLOTS + 1))
    assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    model = grown(4)
    x, y = rng.integers(0, 200, (6, 3)), rng.integers(0, 200, (6, 3))
    keep = np.ones((6, 3), np.float32)
    keep[0] = keep[3, 1] = 0
    h = np.zeros((3, lm.HIDDEN), np.float32)

    def loss(flat):
        m = lm.Gru(flat)
        states, _ = m.forward(x, keep, h)
        return float(m.log_probs(states.reshape(-1, lm.HIDDEN), y.reshape(-1)).astype(float).mean())

    at = model.flat.copy()
    own = lm.Gru(at)
    own.step(x, y, keep, h, rate=1.0)
    # Adagrad's first step is rate * g / sqrt(1e-6 + g * g): solved for g.
    moved = (at - own.flat).astype(float)
    grad = moved * 1e-3 / np.sqrt(np.maximum(1e-12, 1 - np.minimum(moved**2, 1 - 1e-9)))
    usable = np.flatnonzero((np.abs(moved) > 0.05) & (np.abs(moved) < 0.995))
    for i in rng.choice(usable, 60, replace=False):
        up, down = at.copy(), at.copy()
        up[i] += 0.02
        down[i] -= 0.02
        assert -(loss(up) - loss(down)) / 0.04 == pytest.approx(grad[i], rel=0.2, abs=4e-5)


def corpus():
    rng = random.Random(6)
    follow = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(500):
        w, at = [], rng.randrange(200)
        for _ in range(rng.randint(5, 150)):
            w.append(rng.choice(["W", "w"]) + str(at))
            at = rng.choice(follow[at])
        w += [f"rare{i}"] * (i % 3)
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(w)))
    return [*rows, (None, "W1 w2"), (1, rows[1][1]), (1, rows[1][1]), (900, None), (901, ""), (902, "w1 " * 150_000)]


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 3, "c") for i, t in rows], "doc_id long, text string, n_tokens int, held string").repartition(3)
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").lower()), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 3)) for i, t in rows], key=str)
    got = lm.language_scores(df).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got], key=str) == want
    # Text in its order is likelier than single words' shares, for documents that training didn't see.
    mine = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine) * 0.9
    assert all(r.score < 0 for r in got)


def test_no_training_rows_and_nothing(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(only, "a b"), (only, None)], "doc_id long, text string")
    got = lm.language_scores(df).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0), (0, 0)] and all(math.isfinite(r.score) for r in got)
    assert lm.language_scores(df.limit(0)).count() == 0
