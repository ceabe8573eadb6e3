"""Rows repeated whole, and pages that the op2 query cuts into segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.llm.queries import op2_warc
from folio.llm.warc import read_records, reassembled, write_archives


def test_equal_rows_in_segments_come_back_each(spark, tmp_path):
    rows = [(7, "u", "long é " * 2_000)] * 3 + [(6, "u", "long é " * 2_000)] * 2 + [(8, "v", "short")] * 2
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"), segment_bytes=1_000)
    records = read_records(spark, str(tmp_path / "w")).cache()
    assert records.count() == records.select("record_id").distinct().count()
    got = reassembled(records).collect()
    assert sorted((r.page_id, r.record_type, r.intact) for r in got) == [(6, "revisit", True)] * 2 + [(7, "response", True)] * 3 + [(8, "response", True)] * 2


def test_the_query_reassembles_pages(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, str(tmp_path / "w"), segment_bytes=8_192)
    assert read_records(spark, str(tmp_path / "w")).filter("record_type = 'continuation'").count() > 0
    got = op2_warc(spark, sf_dir)
    assert got.count() == pages.count() and got.filter("not intact").count() == 0
    assert got.agg(F.sum("payload_bytes")).collect()[0][0] == pages.agg(F.sum(F.octet_length("html"))).collect()[0][0]
