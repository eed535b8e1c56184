"""WARC: round trips, reassembly in any order, and damage."""

import gzip
import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeq.llm import warc
from latticeq.llm.common import scratch


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 64))
def test_chunked_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload
    with pytest.raises(ValueError):
        warc.dechunked(warc.chunked(payload + b"x", size)[:-6])


def test_records_round_trip():
    payload = random.Random(1).randbytes(5000)
    found = list(warc.records(7, "http://é.example/a b%", payload, hashlib.sha1(payload).hexdigest(), None, False, 900))
    parsed = list(warc.parsed(io.BytesIO(b"".join(r + b"\r\n\r\n" for r in found))))
    assert [h["warc-type"] for h, _ in parsed] == ["response"] + ["continuation"] * (len(found) - 1)
    assert {h["warc-segment-origin-id"] for h, _ in parsed[1:]} == {parsed[0][0]["warc-record-id"]}
    assert int(parsed[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in parsed)
    assert warc.payload_of(b"".join(b for _, b in parsed))[0] == payload


def brute(rows):
    seen = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in seen:
        same = [j for j, q in seen if q == p and j is not None]
        revisit = len(p) >= 1000 and same and i != max(same)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def pages(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé \r\n一") for _ in range(n))
    long, limit, edge = text(3000), "a" * 1000, "a" * 999
    rows = [(i, f"http://x.example/{i}?q=ü%20\r\n", text(rng.choice([0, 1, 50, 998, 4000]))) for i in range(40)]
    rows += [(100, "u", long), (102, None, long), (101, "u", long), (103, "u", limit), (104, "u", limit), (105, "u", edge), (106, "u", edge), (107, "u", None), (108, "u", "")]
    rows += [(109, "u", text(400_000)), (109, "u", "again" * 300), (110, "u", "again" * 300), (111, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (None, "u", long), (None, None, "only null" * 200), (112, "u", "dup" * 500), (112, "u", "dup" * 500)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(3)


def test_archives_against_brute_force(spark):
    rows, df = pages(spark)
    for segment, per_file in ((65_536, 1000), (700, 7)):
        path = scratch(spark, "archives")
        warc.write_archives(df, path, segment, per_file)
        got = warc.read_archives(spark, path).collect()
        assert all(r.problem is None for r in got)
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)
        assert sorted([str((r.page_id, r.url)) for r in got]) == sorted(str(r[:2]) for r in rows)
    path = scratch(spark, "archives")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_damage_is_reported(spark, tmp_path):
    payload = bytes(range(256)) * 20
    digest = hashlib.sha1(payload).hexdigest()
    make = lambda i, d=digest: list(warc.records(i, "u", payload, d, None, False, 1000))
    whole, lost, doubled, wrong = make(1), make(2), make(3), make(4, "0" * 40)
    plain = list(warc.records(5, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, 1000))
    bad = [plain[0].replace(b"\r\n3\r\n", b"\r\n4\r\n")]
    mixed = [*whole, *lost[:2], *lost[3:], *doubled, doubled[2], *wrong, *bad]
    random.Random(0).shuffle(mixed)
    for i in range(3):
        (tmp_path / f"{i}.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in mixed[i::3])))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {i: r.problem for i, r in got.items()} == {1: None, 2: "segments", 3: "segments", 4: "digest", 5: "framing"}
    assert got[1].payload_digest == digest and got[2].payload_digest is None


def test_registered_query_writes_continuations(spark, tmp_path, monkeypatch):
    html = "".join(f"<p>{i} é</p>" for i in range(900))
    spark.createDataFrame([(1, "u", html), (2, "v", "short")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    path = scratch(spark, "archives")
    monkeypatch.setattr(warc, "scratch", lambda *_: path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.query(spark, str(tmp_path)).collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, h in ((1, html), (2, "short"))}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    assert sum(gzip.decompress(r.content).lower().count(b"warc-type: continuation") for r in files) >= 2
