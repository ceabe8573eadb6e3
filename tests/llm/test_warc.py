"""Archives: an exact round trip through segments and chunk framing, and damaged ones."""

from __future__ import annotations

import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm.warc import chunk_framed, chunk_unframed, inflated, page_records, parsed, payload_digest, payload_of, read_records, reassembled, write_archives

SCHEMA = "page_id long, url string, html string, block string"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3\r\nX-Evil: 1", "long é " * 5_000), (4, None, None), (5, "http://a/5", ""), (6, "http://a/6", "\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"),
    (None, "http://a/n", "<p>one</p>"), (7, "http://a/7", "long é " * 5_000), (7, "http://a/7", "long é " * 5_000), (8, "u", "alone"),
]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=500), st.integers(1, 60))
def test_framing(payload, size):
    assert chunk_unframed(chunk_framed(payload, size)) == payload


def test_broken_framing():
    for data in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            chunk_unframed(data)
    assert chunk_unframed(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(120, 300), st.integers(1, 50), st.booleans(), st.integers(1, 97))
def test_records_parse_in_any_pieces(payload, segment, chunk, members, step):
    records = list(page_records(9, "http://x/", payload, payload_digest(payload), None, segment, chunk, "2024-01-01T00:00:00Z"))
    whole = [r + b"\r\n\r\n" for r in records]
    data = b"".join(map(gzip.compress, whole)) if members else gzip.compress(b"".join(whole))
    assert b"".join(inflated(data, step)) == b"".join(whole)
    blocks = [(int(f.get("warc-segment-number", 1)), b) for f, b in parsed(inflated(data, step))]
    assert [k for k, _ in blocks] == list(range(1, len(records) + 1))
    assert payload_of(b"".join(b for _, b in blocks)) == payload


def round_trip(spark, path, rows, **more):
    write_archives(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), path, **more)
    return reassembled(read_records(spark, path))


def test_round_trip(spark, tmp_path):
    got = round_trip(spark, str(tmp_path / "w"), PAGES, segment_bytes=1_000, chunk_bytes=77, file_bytes=6_100).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    best = {}
    for i, _, html in PAGES:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    texts = {i: html or "" for i, _, html in PAGES}
    for r in got:
        payload = texts[r.page_id].encode()
        stored = r.page_id == best[texts[r.page_id]]
        assert r.record_type == ("response" if stored else "revisit") and r.refers_to == (None if stored else best[texts[r.page_id]])
        assert r.payload_bytes == len(payload) and r.payload_digest == payload_digest(payload) and (r.payload is None or bytes(r.payload) == payload) and (r.payload is not None) == stored


def test_least_bytes_and_empty(spark, tmp_path):
    got = round_trip(spark, str(tmp_path / "w"), PAGES, least_bytes=100).collect()
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    assert round_trip(spark, str(tmp_path / "e"), []).count() == 0


def test_missing_segment_is_told(spark, tmp_path):
    write_archives(spark.createDataFrame([(3, "u", "x" * 5_000, ""), (4, "u", "whole", "")], SCHEMA), str(tmp_path / "w"), segment_bytes=1_000)
    records = read_records(spark, str(tmp_path / "w"))
    for broken in (records.filter("segment is null or segment <> 2"), records.withColumn("total", F.col("total") + 1)):
        got = {r.page_id: r for r in reassembled(broken).collect()}
        assert not got[3].intact and got[3].payload is None and got[4].intact


def test_a_very_long_page_takes_time_in_proportion(spark, tmp_path):
    import time

    text = "0123456789abcdef" * (2 << 20)  # 32 MB in 4,096 segments
    write_archives(spark.createDataFrame([(1, "u", text, "")], SCHEMA), str(tmp_path / "w"), segment_bytes=8_192)
    records = read_records(spark, str(tmp_path / "w")).persist()
    records.count()
    began = time.perf_counter()
    got = reassembled(records).select("intact", "payload_bytes", F.sha2("payload", 256).alias("digest")).first()
    assert got.intact and got.payload_bytes == len(text) and time.perf_counter() - began < 10
    records.unpersist()
