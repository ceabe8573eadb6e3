"""What searches and intermediate tables leave on disk, and that cheaper ways give the same rows."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.operators.chunking import as_chunks, fixed_windows, text_windows
from folio.operators.lexical import index_terms, scan_documents, scan_terms, search_terms
from folio.operators.lines import lines_of_texts
from folio.operators.structure import detect_structure
from folio.queries import corpus, statements
from folio.sources.scratch import SHUFFLE_CLEANUP, stored

ODD = [(1, "a b\u00a0c\n\n d\te " * 90), (2, ""), (3, None), (4, "one"), (5, "the boat $5 rent " * 45), (6, " \n"), (7, "Rent rent. the the; boat\x1cdock " * 30)]


def test_windows_of_texts_are_those_of_their_lines(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for config in (EngineConfig(), EngineConfig(window_words=7, window_overlap=3)):
        got, want = as_chunks(text_windows(docs, config=config)), fixed_windows(lines_of_texts(docs), config)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_scan_finds_what_an_index_finds(spark):
    chunks = as_chunks(text_windows(spark.createDataFrame(ODD, "doc_id long, text string")))
    asked = spark.createDataFrame([("q1", "the rent of a boat"), ("q2", "boat boat dock"), ("q3", ""), ("q4", None), ("q5", "zebra")], "query_id string, text string")
    rows = [sorted(tuple(r) for r in search_terms(i, asked, 3).withColumn("score", F.round("score", 9)).collect()) for i in (scan_terms(chunks), index_terms(chunks, per_document=False))]
    assert rows[0] == rows[1] != []


def test_a_lexical_search_stores_no_postings_and_no_grams(spark, sf_dir):
    corpus.BUILT.clear()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    corpus.bm25_topk(spark, sf_dir).collect()
    made = {f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before}
    assert "windows" in made and not made & {"postings", "gram-counts", "gram-weights", "vocabulary"}
    assert "display_text" not in spark.read.parquet(*[f"{base}/{f}" for f in os.listdir(base) if f.startswith("windows-")]).columns


def test_shuffle_files_go_with_the_write(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP)
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: env.blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    had = files()
    kept = stored(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "counts")
    ends = time.time() + 20
    while files() > had and time.time() < ends:
        time.sleep(0.2)
    assert files() <= had and spark.conf.get(SHUFFLE_CLEANUP) == before and kept.count() == 7


def test_tables_stand_where_pairs_of_tables_and_lines_put_them(spark):
    # (page, height) of lines in reading order, some alike, some out of order, some unknown; tables between, at and beyond them
    lines = [("a", 1, 10.0), ("a", 1, 30.0), ("a", 1, 30.0), ("a", 2, 5.0), ("a", 2, None), ("a", 1, 50.0), ("a", 3, 7.0), ("b", 1, 1.0)]
    tables = [("a", 1, 30.0, 1), ("a", 1, 29.0, 2), ("a", 2, 4.0, 3), ("a", 2, None, 4), ("a", 3, 7.0, 5), ("a", 1, 30.0, 6), ("b", 9, 9.0, 1), ("c", 1, 1.0, 1)]
    rows = [(d, k, p, y, 10.0, False, f"line {k}") for k, (d, p, y) in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "document_id string, line_no long, page int, y0 double, font_size double, is_bold boolean, text string")
    given = spark.createDataFrame([(d, f"{d}{n}", n, p, y) for d, p, y, n in tables], "document_id string, table_id string, table_no int, page int, y0 double")
    body = spark.createDataFrame([(d, 10.0) for d in "abc"], "document_id string, body_font_size double")
    blocks = detect_structure(df, body, given)
    assert "Join" not in blocks.filter("table_id is not null")._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner", "")
    least = -1.0
    place = lambda p, y: (p, least if y is None else y)
    at, no = {}, {}
    for d, k, p, y, *_ in rows:
        no[d] = at[d, k] = no.get(d, 0) + 1
    want = {}
    for d in "abc":
        order = [(at[d, k], 1, 0, 0.0, 0, f"line {k}") for e, k, *_ in rows if e == d]
        for e, p, y, n in tables:
            if e == d:
                below = [at[d, k] for f, k, q, z, *_ in rows if f == d and place(q, z) > place(p, y)]
                order.append((min(below, default=1 << 60), 0, p, place(p, y)[1], n, f"[table:{d}{n}]"))
        want[d] = [x[-1] for x in sorted(order)]
    got = {d: [r.text for r in blocks.filter(blocks.document_id == d).orderBy("block_no").collect()] for d in "abc"}
    assert got == want


def test_running_lines_and_blocks_build_no_index(spark, sf_dir):
    statements.BUILT.clear()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    assert statements.statement_running_lines(spark, sf_dir).count() > 0 and statements.statement_blocks(spark, sf_dir).count() > 0
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before} == {"orders", "items", "lines", "tables"}


def test_nodes_are_stored_once_and_in_buckets_that_need_no_shuffle(spark, sf_dir):
    statements.BUILT.clear()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    assert statements.statement_tree(spark, sf_dir).count() > 0 and statements.statement_packed(spark, sf_dir).count() > 0 and statements.statement_descendants(spark, sf_dir).count() > 0
    assert sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before) == ["items", "lines", "nodes", "orders", "tables"]
    grouped = statements.statements(spark, sf_dir).nodes.groupBy("document_id", "depth").count()
    assert grouped.count() > 0 and "hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_a_scan_of_documents_finds_what_their_index_finds(spark, sf_dir):
    texts = [(k, " ".join("boat" if n % 97 == k else "rent" if n % 61 == 0 else f"w{n % (50 + k)}" for n in range(200 + 30 * k))) for k in range(1, 5)]
    chunks = as_chunks(text_windows(spark.createDataFrame([*texts, *ODD[1:4]], "doc_id long, text string"), config=EngineConfig(window_words=30, window_overlap=5)))
    asked = spark.createDataFrame([("q1", "1", "boat rent rent"), ("q2", "4", "the boat w7"), ("q3", "3", "w3 w4"), ("q4", None, "boat rent"), ("q5", "9", "one")], "query_id string, document_id string, text string")
    rows = [sorted(tuple(r) for r in search_terms(i, asked, 3).withColumn("score", F.round("score", 9)).collect()) for i in (scan_documents(chunks), index_terms(chunks))]
    assert rows[0] == rows[1] != []


def test_statement_searches_store_no_postings(spark, sf_dir):
    statements.BUILT.clear()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    assert statements.statement_references(spark, sf_dir).count() > 0
    assert not {f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before} & {"postings", "lengths", "raw-weights", "weights"}
