"""The PDF reader, over a double of pdfplumber that reads pages from JSON."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folio.operators.lines import assemble_lines, numbered_lines, outside_tables
from folio.sources.pdf import read_pdfs

DOUBLE = '''
import contextlib, json


class Table:
    def __init__(self, spec):
        self.bbox, self.rows = spec["bbox"], spec["rows"]

    def extract(self):
        return self.rows


class Page:
    def __init__(self, spec):
        self.spec = spec

    def find_tables(self):
        return [Table(t) for t in self.spec.get("tables", [])]

    def extract_words(self, extra_attrs):
        assert extra_attrs == ["size", "fontname"]
        return [dict(zip(("text", "x0", "x1", "top", "bottom", "size", "fontname"), w)) for w in self.spec.get("words", [])]


class Pdf:
    def __init__(self, spec):
        self.pages = [Page(p) for p in spec["pages"]]


@contextlib.contextmanager
def open(stream):
    yield Pdf(json.load(stream))
'''

LEASE = {
    "pages": [
        {
            "words": [["Boat", 10, 30, 20.0, 30, 16, "Sans-Bold"], ["Lease", 35, 60, 20.04, 30, 16, "Sans-Bold"], ["Fees", 10, 30, 60, 70, 10, "Sans"], ["follow.", 32, 60, 61.5, 71, 10, "Sans"], ["Class", 12, 30, 101, 110, 10, "Sans"], ["after", 10, 30, 160, 170, 10, "Sans"]],
            "tables": [{"bbox": [10, 100, 90, 140], "rows": [[" Class ", None], ["A", "$5"], [None, None]]}, {"bbox": [10, 200, 90, 240], "rows": [[None, ""]]}, {"bbox": [0, 300, 1, 301], "rows": []}],
        },
        {"words": [], "tables": [{"bbox": [10, 10, 90, 40], "rows": [["Term"], ["2 years"]]}]},
        {},
    ]
}


@pytest.fixture(scope="module")
def pdfs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    (folder / "pdfplumber.py").write_text(DOUBLE)
    spark.sparkContext.addPyFile(str(folder / "pdfplumber.py"))
    (folder / "in").mkdir()
    (folder / "in" / "lease.pdf").write_text(json.dumps(LEASE))
    (folder / "in" / "empty.pdf").write_text(json.dumps({"pages": []}))
    return read_pdfs(spark, str(folder / "in"))


def test_words_tables_and_boxes(pdfs):
    words, tables, boxes = pdfs
    name = hashlib.sha256(json.dumps(LEASE).encode()).hexdigest()[:8]
    assert {r.document_id for r in words.collect()} == {name} and words.count() == 6
    got = {r.table_no: (r.table_id, r.page, r.y0, r.headers, r.rows) for r in tables.collect()}
    # a table without any filled cell is none, and numbers go on over pages
    assert got == {1: (f"{name}-tbl-1", 1, 100.0, ["Class", ""], [["A", "$5"], ["", ""]]), 2: (f"{name}-tbl-2", 2, 10.0, ["Term"], [["2 years"]])}
    assert boxes.count() == 2


def test_lines_from_a_pdf(pdfs):
    words, _, boxes = pdfs
    lines = numbered_lines(assemble_lines(outside_tables(words, boxes))).withColumn("document_name", F.lit("Boat Lease")).orderBy("line_no").collect()
    assert [(r.page, r.text, r.is_bold) for r in lines] == [(1, "Boat Lease", True), (1, "Fees follow.", False), (1, "after", False)]
    assert lines[0].font_size == 16.0
