"""Pfair schedules: deviation, whole results, skew of sources."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeq.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_every_prefix_of_a_period_is_within_one_block(shares):
    order, total = mixing.period(shares), sum(shares)
    assert len(order) == total
    got = [0] * len(shares)
    for slot, s in enumerate(order, 1):
        got[s] += 1
        assert all(abs(g * total - slot * p) < total for g, p in zip(got, shares, strict=True))
    assert got == shares


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 60)), min_size=1, max_size=6))
def test_phases_place_every_block_once(given_):
    shares, blocks = [p for p, _ in given_], [b for _, b in given_]
    seen = Counter()
    last = 0
    for start, total, order, got in mixing.phases(shares, blocks):
        assert start == last and total == len(order)
        last += sum(n for _, n in got.values())
        for s, (first, n) in got.items():
            assert first == seen[s]
            seen[s] += n
    assert [seen[s] for s in range(len(shares))] == blocks


def test_target_shares():
    assert mixing.target_shares([]) == [] and mixing.target_shares([100, 100]) == [500, 500]
    assert mixing.target_shares([10**9, 1]) == [1000, 1]


@pytest.mark.parametrize("cell_rows", [16, 4096])
def test_mixture(spark, cell_rows):
    rng = random.Random(1)
    sources = ["hot"] * 400 + ["a"] * 90 + ["b"] * 33 + ["one"] + [None] * 20 + [""] * 5
    rng.shuffle(sources)
    rows = [(i, s, f"t{i}", 1, "x") for i, s in enumerate(sources)] + [(None, "a", "n", 1, "x"), (None, "a", "n", 1, "x"), (3, sources[3], "again", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, start int, turn string").repartition(4)
    weights = {"hot": 5, "a": 3, "b": 1, "absent": 9}
    out = mixing.mix_sources(df, weights, block_rows=8, keep=df.columns, cell_rows=cell_rows)
    assert out.columns == [*df.columns, "block", "slot", "place"]
    got = sorted(out.collect(), key=lambda r: r.place)
    assert Counter((r.doc_id, r.source, r.text, r.start, r.turn) for r in got) == Counter(rows)
    assert len({r.place for r in got}) == len(rows)
    # Each slot holds one block of one source, and only a source's last block is short.
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    assert sorted(slots) == list(range(len(slots)))
    assert all(len({(r.source, r.block) for r in s}) == 1 and [r.place for r in s] == [s[0].slot * 8 + i for i in range(len(s))] for s in slots.values())
    sizes = Counter(r[1] for r in rows)
    for s, n in sizes.items():
        own = sorted((x[0].block, len(x)) for x in slots.values() if x[0].source == s)
        assert own == [(i, min(8, n - 8 * i)) for i in range(math.ceil(n / 8))]
    # While all sources last, each has its share of slots to within one block.
    shares = {s: weights.get(s, 1) for s in sizes}
    total, seen = sum(shares.values()), Counter()
    ended = min(max(k for k, v in slots.items() if v[0].source == s) for s in sizes)
    for k in range(ended):
        seen[slots[k][0].source] += 1
        assert all(abs(seen[s] * total - (k + 1) * p) < total for s, p in shares.items())


def test_mixture_defaults_and_empty_tables(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "7 AS block")
    out = mixing.mix_sources(df, keep=["doc_id", "source", "block"])
    assert out.columns == ["doc_id", "source", "block", "slot", "place"] and out.select("place").distinct().count() == 300
    assert mixing.mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [None, {"hot": 900, "s7": 40, "absent": 3}])
def test_more_sources_than_lanes(spark, weights):
    rng = random.Random(2)
    sources = ["hot"] * 1500 + [None] * 90 + [f"s{i}" for i in range(600) for _ in range(1 + i % 3)]
    rng.shuffle(sources)
    df = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string").repartition(4)
    got = sorted(mixing.mix_sources(df, weights, block_rows=2, most_lanes=20).collect(), key=lambda r: r.place)
    assert sorted((r.doc_id, r.source) for r in got) == sorted(enumerate(sources), key=lambda x: x[0])
    assert len({r.place for r in got}) == len(got)
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    # No slot stays empty, and each has one block of one source.
    assert sorted(slots) == list(range(len(slots)))
    assert all(len({(r.source, r.block) for r in s}) == 1 for s in slots.values())
    for s, n in Counter(sources).items():
        assert sorted({(x[0].block, len(x)) for x in slots.values() if x[0].source == s}) == [(i, min(2, n - 2 * i)) for i in range(math.ceil(n / 2))]
    # A source with a lane of its own has its weight to within one block while no lane has ended.
    sizes = Counter(sources)
    raw = {s: max(1, weights.get(s, 3)) if weights else math.sqrt(n) for s, n in sizes.items()}
    share = round(1000 * raw["hot"] / sum(raw.values()))
    seen = 0
    for k in range(len(slots) // 20):
        seen += slots[k][0].source == "hot"
        assert abs(seen - (k + 1) * share / 1000) < 1 + (k + 1) / 100


def test_blocks_of_a_shared_lane_are_within_one_of_their_weights():
    import pandas as pd

    sources = pd.DataFrame({"source": ["a", None, "b"], "blocks": [40, 10, 20], "weight": [4.0, 1.0, 2.0]})
    out = mixing.lane_order(sources).sort_values("q")
    assert out["q"].tolist() == list(range(70))
    shares = dict(zip([None, "a", "b"], mixing.target_shares([1.0, 4.0, 2.0], power=1.0), strict=True))
    total, seen = sum(shares.values()), Counter()
    for k, s in enumerate(out["source"].tolist()[:60], 1):
        seen[s] += 1
        assert all(abs(seen[x] * total - k * p) < total for x, p in shares.items())
    for s, rows in out.groupby("source", dropna=False):
        assert rows["block"].tolist() == list(range(len(rows)))
