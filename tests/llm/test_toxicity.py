"""The classifier chain: held-out accuracy, scores against plain Python, awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from latticeq.llm import text as X
from latticeq.llm import toxicity

BAD = ["grubbler", "snarkfool", "vilewort", "ÄRGLUMP"]


def made(rng, toxic, words=60):
    out = [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice(["len", "ta", "rok", "mi"]) + rng.choice(["", "s", "en"]) for _ in range(words)]
    for _ in range(3 * toxic):
        out[rng.randrange(words)] = rng.choice(BAD)
    return " ".join(out).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, made(rng, i % 5 == 0, rng.randint(20, 200))) for i in range(900)]
    labels = [(i, rng.randint(0, 1), int(i % 5 == 0)) for i in range(0, 900, 2)]
    odd = [(None, "snarkfool"), (901, None), (902, ""), (0, rows[0][1]), (903, "vilewort " * 50_000), (904, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows + odd], "doc_id long, text string, rejected string, p_toxic double").cache()
    wanted = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), (7, 1, None), (0, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, wanted


@pytest.fixture(scope="module")
def chain(corpus):
    return toxicity.train(*corpus, toxicity.default_categories())


def test_held_out_accuracy(corpus, chain):
    got = {r.doc_id: r for r in toxicity.score(corpus[0], chain).collect() if r.doc_id is not None and r.doc_id < 900}
    wrong = [i for i, r in got.items() if i % 2 and r.rejected != (i % 5 == 0)]
    assert len(got) == 900 and len(wrong) <= 4
    assert chain.categories == ["low_quality", "toxic"] and len(chain.models[1].earlier) == 1 and len(chain.models[0].earlier) == 0


def test_scores_against_plain_python(corpus, chain):
    docs, _ = corpus
    at = {int(h): i for i, h in enumerate(chain.vocabulary)}

    def hashed(b):
        return int(X.words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), X.NON_LETTERS, X.FOLDED_CODES).hashes[0])

    def starts(b, n):
        t = X.words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), X.NON_LETTERS, X.FOLDED_CODES, running=True)
        return [int(h) for h in t.prefix_hashes(n)[0]]

    for r in toxicity.score(docs, chain, keep=["doc_id", "text"]).where("doc_id < 40").collect():
        words = [w.lower().encode() for w in re.findall(r"[A-Za-z\u0080-\uffff]+", r.text)]
        keys = Counter(hashed(w) for w in words)
        for n in toxicity.PREFIXES:
            keys.update(h for w in words for h in starts(w, n))
        p = []
        for m in chain.models:
            z = m.bias + sum(m.weights[2 * at[h]] * math.log1p(k) + m.weights[2 * at[h] + 1] * min(3.0, 50 * k / len(words)) for h, k in keys.items() if h in at)
            # Earlier categories enter as probabilities.
            z += sum(w * x for w, x in zip(m.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-float(np.clip(z, -8, 8)))))
        assert [r.p_low_quality, r.p_toxic] == pytest.approx(p, rel=1e-6)
        assert r.rejected == (r.p_toxic >= chain.threshold)


def test_awkward_rows_and_clashing_columns(corpus, chain):
    docs, labels = corpus
    out = toxicity.score(docs, chain).collect()
    assert len(out) == 906
    by = {r.doc_id: r for r in out}
    assert by[None].rejected and by[903].rejected and not by[901].rejected and by[901][1:] == by[902][1:]
    kept = toxicity.without_rejected(docs, chain)
    assert kept.schema == docs.schema and kept.count() == sum(not r.rejected for r in out)
    nothing = docs.limit(0)
    assert toxicity.score(nothing, chain).count() == 0
    for d, w in ((nothing, labels), (docs, labels.limit(0)), (docs, labels.where("toxic = 0"))):
        assert toxicity.score(docs, toxicity.train(d, w, toxicity.default_categories())).where("rejected").count() == 0


def test_labels_without_bearing_reject_nothing(spark):
    # Features chosen or weights fitted with a row's own label would predict even these labels out of fold.
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, made(rng, 0, 80)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, rng.randint(0, 1), int(rng.random() < 0.3)) for i in range(600)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="nothing is rejected"):
        chain = toxicity.train(docs, labels, toxicity.default_categories())
    assert toxicity.score(docs, chain).where("rejected").isEmpty()


def test_chain_uses_earlier_probabilities(spark):
    # The second category is "the first, or a word": the chain has to learn a weight for the first's probability.
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        first, word = i % 4 == 0, i % 7 == 0
        rows.append((i, " ".join([made(rng, 0, 40), *(["omenword"] * first), *(["tellword"] * word)])))
        labels.append((i, int(not first), int(first or word)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.default_categories())
    assert chain.models[1].earlier[0] > 0.5
    wrong = [r.doc_id for r in toxicity.score(docs, chain).collect() if r.rejected != (r.doc_id % 4 == 0 or r.doc_id % 7 == 0)]
    assert len(wrong) <= 8


def test_bound_counts_labelled_documents_only(spark, corpus):
    docs, labels = corpus
    absent = spark.range(10_000, 60_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    lacking = labels.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN quality END AS quality", "toxic")
    names = [n for n, _ in toxicity.default_categories()]
    found = toxicity.labelled(docs, lacking.union(absent), toxicity.default_categories(), 100_000).collect()
    assert {r.id for r in found} == {i for i in range(0, 900, 2)} | {5}
    assert {r.id for r in found if r[names[0]] is None} == {i for i in range(0, 900, 2) if i % 3} | {5}
    some = toxicity.labelled(docs, lacking.union(absent), toxicity.default_categories(), 200).collect()
    assert len(some) == 200 and all(r[names[1]] is not None and r.id < 900 for r in some)


def test_best_threshold_by_trying_all():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 12)
        odds = np.array([rng.choice([-2.0, -1.0, 0.0, 0.5, 3.0]) for _ in range(n)])
        label = np.array([float(rng.random() < 0.5) for _ in range(n)])
        best = None
        for cut in sorted(set(odds), reverse=True):
            hit, many = label[odds >= cut].sum(), (odds >= cut).sum()
            if hit and hit >= 0.7 * many and (best is None or 2 * hit / (many + label.sum()) > best[0]):
                best = 2 * hit / (many + label.sum()), cut
        got = toxicity.best_threshold(odds, label, 0.7)
        assert (got is None) == (best is None)
        if best:
            p = 1 / (1 + np.exp(-odds))
            assert ((p >= got) == (odds >= best[1])).all()
