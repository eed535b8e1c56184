"""Tokens, near-duplicates and decontamination against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeq.llm import common, decontamination, neardup
from latticeq.llm import text as X
from latticeq.llm.common import components

SPACE = "[^\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, n_shingles string, kept int, component_id string"


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n):
    w = re.findall(SPACE, folded(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉß一 \t\n\x0b\x1c ", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_and_shingles(texts, piece):
    column = pa.array(texts, pa.string())
    seen = []
    for lo, hi, data, at in X.pieces(column, piece):
        t = X.words(data, at, codes=X.FOLDED_CODES)
        for i in range(hi - lo):
            a, b = t.rows[i], t.rows[i + 1]
            assert [bytes(data[s:e]).decode() for s, e in zip(t.starts[a:b], t.ends[a:b], strict=True)] == re.findall(SPACE, texts[lo + i] or "")
        seen += [len(s) for s in X.shingle_sets(t, 3)]
    assert seen == [len(shingles(x, 3)) for x in texts]


def test_prefix_hashes_depend_on_the_prefix_only():
    data = np.frombuffer(b"abcdef abcdxy zabcdef abcd", np.uint8)
    t = X.words(data, np.array([0, len(data)]), running=True)
    hashes, which = t.prefix_hashes(4)
    assert list(which) == [0, 1, 2] and hashes[0] == hashes[1] != hashes[2]


def brute_components(rows, n, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def varied(rng, words, share):
    return [rng.choice("pqrstuvw") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "in", "w" + str(rng.randint(0, 4000))])
    passage = [word() for _ in range(60)]
    rows, at = [], 0
    for size in (3, 9, 40, 55, 70, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(rng.randint(1, 6)):
                rows.append((at := at + 1, " ".join(varied(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.06])))))
    family = [word() for _ in range(150)]
    rows += [(at + 1 + i, " ".join(varied(rng, family, rng.choice([0.01, 0.02, 0.03, 0.05])))) for i in range(60)]
    at += 60
    rows += [(at + 1 + i, " ".join(passage + [word() for _ in range(rng.randint(5, 100))])) for i in range(40)]
    at += 40
    rows += [(at + 1, None), (at + 2, ""), (at + 3, " \n"), (at + 4, "one TWO"), (at + 5, "One two"), (None, rows[0][1]), rows[5], (at + 6, "x" * 100_000), (at + 7, "many words " * 20_000)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    for seed, size in ((1, 5), (2, 4)):
        rows = corpus(seed)
        want = brute_components(rows, size, 80)
        df = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)
        out = neardup.near_duplicates(df, size=size).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
        sizes = {r.doc_id: r.n_shingles for r in out if r.doc_id is not None}
        assert all(sizes[i] == len(shingles(t, size)) for i, t in rows if i is not None)
        left = neardup.without_copies(df, size=size)
        assert left.columns == df.columns
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(want.values()))
        assert left.where("doc_id is null").count() == 1


def test_large_lists_are_searched_as_families(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 2)
    # Many parts a list, so that each meets its leader and state by salt.
    monkeypatch.setattr(neardup, "LIST_ROWS", 3)
    monkeypatch.setattr(neardup, "INDEX_SHINGLES", 2000)
    monkeypatch.setattr(neardup, "PIVOT_SHINGLES", 3000)
    rows = corpus(3)
    want = brute_components(rows, 5, 80)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want


def test_bucket_counts_reach_the_driver_packed(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKETS", 1 << 12)
    monkeypatch.setattr(neardup, "SLICE", 1 << 8, raising=False)
    values = np.random.default_rng(5).integers(0, 2**63, (1000, 64)).astype(np.uint64)
    values[:, 0] = 7
    # One slice is left empty, one bucket holds a single value.
    values[values & np.uint64(0xF00) == np.uint64(0x300)] = 9
    values[0, 1] = 0x3FF
    kept = spark.createDataFrame([(v.tobytes(),) for v in values] + [(b"",)], "sketch binary").repartition(5)
    collect, sent = type(kept).toArrow, []
    monkeypatch.setattr(type(kept), "toArrow", lambda df: sent.append(collect(df)) or sent[-1])
    got = neardup.bucket_counts(kept, spark)
    want = np.bincount((values & np.uint64(0xFFF)).astype(np.int64).ravel(), minlength=1 << 12)
    assert got.dtype == np.int32 and (got == np.maximum(want, 1)).all() and want[0x3FF] == 1
    assert sum(x.nbytes for x in sent) < 5 * (1 << 12)
    assert (neardup.bucket_counts(kept.limit(0), spark) == 1).all()


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200)]
    root = {x: x for p in links for x in p}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in root.items() if any(i in p and p[0] != p[1] for p in links)}


def test_components_in_one_task_or_in_rounds(spark, monkeypatch):
    rng = random.Random(1)
    ids = list({rng.randint(-(2**62), 2**62) for _ in range(300)})
    rng.shuffle(ids)
    # A long chain in no order of ids, stars, repeated and reversed links, one id alone.
    links = list(zip(ids[:150], ids[1:150], strict=False)) + [(ids[150 + i % 3], x) for i, x in enumerate(ids[153:298])]
    links += [(b, a) for a, b in links[:20]] + links[30:50] + [(ids[298], ids[298])]
    want = {x: min(ids[:150]) for x in ids[:150]}
    for k in range(3):
        star = [ids[150 + k], *ids[153 + k : 298 : 3]]
        want |= dict.fromkeys(star, min(star))
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    for most, group in ((1 << 21, "task"), (0, "rounds")):
        monkeypatch.setattr(common, "TASK_LINKS", most, raising=False)
        spark.sparkContext.setJobGroup(group, group)
        found = components(df)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows = found.collect()
        assert len(rows) == len(want) and {r.id: r.component for r in rows} == want
        # Plans of every round took threads, classes and heap of the driver.
        assert jobs <= 6 if most else jobs > 6
    assert components(df.limit(0)).collect() == []
    monkeypatch.setattr(common, "BATCH_ROWS", 64)
    batches = list(common._joined(pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}).to_batches(max_chunksize=50)))
    assert len(batches) == 5 and {i: c for x in batches for i, c in zip(*[c.to_pylist() for c in x.columns], strict=True)} == want | {ids[298]: ids[298]}


def test_decontamination(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["The", "of"] + ["w%d" % rng.randint(0, 3000)] * 3) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([12, 20, 45, 90, 300, 700, 2500] * 3)] + [(90, None), (91, ""), (92, "tiny item"), (1, None)]
    docs = [(i, text(rng.choice([30, 200, 5000]))) for i in range(20)]
    for i, t in items[:21]:
        w = t.split()
        lo = len(w) // 12
        docs += [(1000 + i, text(400) + "\n" + t.upper().replace("Ä", "ä") + " " + text(300)), (2000 + i, text(100) + " " + " ".join(w[lo : len(w) - lo]) + " " + text(50)), (3000 + i, " ".join(w[: len(w) // 2]))]
    docs += [(5000, None), (5001, ""), (5002, "a Tiny item here"), (None, items[2][1]), (1002, items[2][1])]
    want = []
    for d, t in docs:
        have = shingles(t, 5)
        for i, x in set(items):
            need = shingles(x, 5)
            hit = len(need & have)
            if need and 100 * hit >= 80 * len(need):
                want.append((d, i, len(need), hit))
    want.append((5002, 92, 1, 1))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_item int, n_shared string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for block in (1 << 26, 5000):
        got = [tuple(r) for r in decontamination.contaminated(df, bench, block_bytes=block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    blocks = list(decontamination.blocks_of(bench, "item_id", "text", 5, 80, 64, 5000))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == len({x for x in items if x[1]})
    clean = decontamination.without_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == len(docs) - len([d for d in docs if any(w[0] == d[0] for w in want)])
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
