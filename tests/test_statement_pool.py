"""Fusion and references share one search, which counts only terms that a question asks for."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from folio.operators.chunking import as_chunks, text_windows
from folio.operators.lexical import scan_documents
from folio.queries import statements


def test_one_search_serves_both(spark, sf_dir):
    statements.BUILT.clear()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    assert statements.statement_fusion(spark, sf_dir).count() > 0 and statements.statement_references(spark, sf_dir).count() > 0
    made = [f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before]
    assert made.count("hits") == made.count("pool") == made.count("analysed") == 1


def test_terms_are_dropped_before_they_are_counted(spark):
    chunks = as_chunks(text_windows(spark.createDataFrame([(1, "boat rent boat"), (2, "rent"), (3, None)], "doc_id long, text string")))
    wanted = spark.createDataFrame([("boat",)], "term string")
    found = scan_documents(chunks).postings.join(F.broadcast(wanted), "term", "left_semi")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi") and [(r.document_id, r.tf) for r in found.collect()] == [("1", 2)]
