"""PDF reader: words and tables of pages. Needs pdfplumber, which is optional; the engine proper starts at words or lines."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def cells(rows: list[list[str | None]]) -> list[list[str]]:
    return [[(c or "").strip() for c in row] for row in rows]


def page_rows(content: bytes, document_id: str) -> Iterator[tuple]:
    """(page, words, tables) of a PDF; a table without any filled cell is skipped."""
    import pdfplumber

    count = 0
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for number, page in enumerate(pdf.pages, start=1):
            tables = []
            for t in page.find_tables():
                found = t.extract()
                if not found or not any(any(c for c in row) for row in found):
                    continue
                count += 1
                clean = cells(found)
                x0, top, x1, bottom = map(float, t.bbox)
                tables.append((f"{document_id}-tbl-{count}", count, x0, top, x1, bottom, clean[0], clean[1:]))
            words = [(w["text"], float(w["x0"]), float(w["x1"]), float(w["top"]), float(w["bottom"]), float(w.get("size", 10.0)), w.get("fontname", "")) for w in page.extract_words(extra_attrs=["size", "fontname"])]
            yield number, words, tables


def read_pdfs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, tables, boxes) of the PDFs at ``path``, each parsed by one task; ids are hashes of the contents."""
    schema = (
        "document_id string, page int, words array<struct<text: string, x0: double, x1: double, top: double, bottom: double, size: double, fontname: string>>, "
        "tables array<struct<table_id: string, table_no: int, bx0: double, btop: double, bx1: double, bbottom: double, headers: array<string>, rows: array<array<string>>>>"
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["document_id"], batch["content"]):
                for number, words, tables in page_rows(content, name):
                    yield pd.DataFrame({"document_id": [name], "page": [number], "words": [words], "tables": [tables]})

    files = spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 8).alias("document_id"), "content")
    pages = files.mapInPandas(parse, schema)
    words = pages.select("document_id", "page", F.explode("words").alias("w")).select("document_id", "page", "w.*")
    boxes = pages.select("document_id", "page", F.explode("tables").alias("t")).select("document_id", "page", "t.*")
    tables = boxes.select("document_id", "table_id", "table_no", "page", F.col("btop").alias("y0"), "headers", "rows")
    return words, tables, boxes.select("document_id", "page", "bx0", "btop", "bx1", "bbottom")
