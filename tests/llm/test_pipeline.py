"""The pipeline, stage by stage, against plain Python; its whole result on awkward tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from latticeq.llm import secrets, toxicity

from .test_text_and_pairs import brute_components, shingles
from .test_toxicity import made

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(seed=11):
    rng = random.Random(seed)
    items = [(i, made(rng, 0, rng.randint(15, 80))) for i in range(6)] + [(6, None), (7, "")]
    texts = [made(rng, i % 6 == 0, rng.randint(30, 150)) for i in range(240)]
    for i in range(30):
        texts.append(texts[i * 3 + 1])
        texts.append(" ".join([*texts[i * 3 + 2].split()[:-1], "zzz"]))
    texts += [made(rng, 0, 50) + " " + items[i % 6][1] + " " + made(rng, 0, 40) for i in range(12)]
    texts += [made(rng, 0, 40) + "\npassword = hunter2hunter2\nuser: alice\nZx9Qw3Er7Ty1Ui5Op2As4Df6" for _ in range(8)]
    rows = [(i, t, "en", rng.choice(["hot", "hot", "hot", "a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[0] + " grubbler snarkfool vilewort grubbler", None, "a", 1), (None, "fine and clean", None, None, None), (rows[4][0], *rows[4][1:]), (1000, None, "en", "a", 0), (1001, "", "de", "b", 0)]
    labels = [(i, rng.randint(0, 1), int(i < 240 and i % 6 == 0)) for i in range(len(texts)) if i % 2 == 0 or i % 5 == 0]
    return rows, labels, items


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, labels, items = tables()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def as_rows(df):
    return Counter(tuple(r[c] for c in NAMES) for r in df.collect())


def brute(name, rows, spark, where):
    """What a stage should keep of ``rows``."""
    if name == "toxicity":
        docs = spark.createDataFrame(rows, SCHEMA)
        chain = toxicity.train(docs, spark.read.parquet(f"{where}/labels.parquet"), toxicity.default_categories())
        bad = {(r.doc_id, r.text) for r in toxicity.score(docs, chain, keep=["doc_id", "text"]).collect() if r.rejected}
        return [r for r in rows if (r[0], r[1]) not in bad]
    if name == "near-duplicates":
        root = brute_components([(r[0], r[1]) for r in rows], 5, 80)
        seen, out = set(), []
        for r in rows:
            if r[0] is None or (root[r[0]] == r[0] and r[0] not in seen):
                seen.add(r[0])
                out.append(r)
        return out
    if name == "decontamination":
        items = [s for r in spark.read.parquet(f"{where}/benchmark.parquet").collect() if (s := shingles(r.text, 5))]
        return [r for r in rows if not any(100 * len(s & shingles(r[1], 5)) >= 80 * len(s) for s in items)]
    if name == "secrets":
        fixed = lambda r: (r[0], t := secrets.redacted(r[1]), r[2], r[3], len(t) if t is not None and t != r[1] else r[4])
        return [fixed(r) for r in rows]
    return rows


def test_stages(spark, where, tmp_path):
    rows, _, _ = tables()
    df = spark.createDataFrame(rows, SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        want = brute(name, rows, spark, where)
        out = stage(spark, df, where)
        assert out.columns[: len(NAMES)] == NAMES and (k == 4 or out.columns == NAMES)
        assert as_rows(out) == Counter(want)
        assert len(want) < len(rows) or name in ("secrets", "mixing")
        assert want != rows or name == "mixing"
        out.select(NAMES).write.parquet(str(tmp_path / str(k)))
        df, rows = spark.read.schema(SCHEMA).parquet(str(tmp_path / str(k))), want
    final = corpus_pipeline.run(spark, where)
    assert as_rows(final) == Counter(rows) and final.select("place").distinct().count() == len(rows)
    # Planted toxic documents are gone, clean ones stay.
    kept = {r[0] for r in rows}
    assert not [i for i in range(0, 240, 6) if i in kept] and len([i for i in range(240) if i % 6 and i in kept]) >= 196


def test_extra_columns_and_empty_tables(spark, where):
    clash = ["rejected", "p_toxic", "component_id", "kept", "n_shingles", "spans", "id", "n", "start", "turn"]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    wide = docs.selectExpr("*", *[f"'x' AS {c}" for c in clash])
    for rows in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, where)
            assert out.columns[: len(rows.columns)] == rows.columns, name
            assert rows is wide or out.count() == 0
            assert rows is not wide or out.where(" or ".join(f"{c} is null or {c} <> 'x'" for c in clash)).isEmpty()
