"""Searches of many questions over a whole corpus: every pair is scored, and few become rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.operators.chunking import as_chunks, text_windows
from folio.operators.dense import index_grams, scan_grams, search_grams
from folio.operators.lexical import index_terms, scan_terms, score_vectors, search_terms
from folio.queries import corpus

# texts are much alike in eighths, so ties are many; "the" is in all, which makes its weight a share of the mean
TEXTS = [(k, " ".join(["the", *(f"w{(k % 8) * 5 + n}" for n in range(12)), *(["boat"] * (k % 3))])) for k in range(40)]
ASKED = [(f"q{k}", " ".join(["the", f"w{k % 45}", f"w{k % 37}", f"w{k % 37}", *(["boat"] if k % 5 == 0 else [])])) for k in range(60)] + [("none", "zebra"), ("empty", ""), ("null", None)]


def by_hand(top_k: int) -> list[tuple]:
    docs = [(str(k), t.split()) for k, t in TEXTS]
    df = Counter(w for _, t in docs for w in set(t))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    mean = sum(len(t) for _, t in docs) / len(docs)
    out = []
    for q, text in ASKED:
        found = []
        for d, t in docs:
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in (text or "").split() if tf[w])
            if s > 0:
                found.append((-math.floor(s * 1e9 + 0.5), d))
        out += [(q, d, n) for n, (_, d) in enumerate(sorted(found)[:top_k], 1)]
    assert len(out) > 100
    return sorted(out)


def test_many_questions_find_what_scores_by_hand_say(spark):
    chunks = as_chunks(text_windows(spark.createDataFrame(TEXTS, "doc_id long, text string")))
    asked = spark.createDataFrame(ASKED, "query_id string, text string")
    for index in (scan_terms(chunks), index_terms(chunks, per_document=False)):
        found = search_terms(index, asked, 4)
        # pairs are scored in blocks inside tasks: no join gives a row for each
        assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r.document_id, r["rank"]) for r in found.collect()) == by_hand(4)


@pytest.mark.parametrize(("block_bytes", "most_scores"), [(1, 1), (300, 7), (1 << 20, 1 << 20)])
def test_blocks_of_any_size_give_the_same_and_pass_on_few(spark, block_bytes, most_scores):
    # terms 0 to 2 are common, others rare; some parts are negative
    vectors = [(str(c), f"c{c}", 1, [0, 1, 2 + c % 5], [1.0 + c % 4, -0.5, 0.25 * (c % 6)]) for c in range(50)] + [("x", "cx", 1, [99], [1.0])]
    asked = [(q, no, float(times)) for q in range(9) for no, times in ((0, 1), (1, q % 3), (2 + q % 6, 2)) if times]
    rows = spark.createDataFrame(vectors, "document_id string, chunk_id string, chunk_no long, no array<long>, w array<double>").repartition(2, "chunk_id")
    found = score_vectors(rows, spark.createDataFrame(asked, "query_id long, no long, times double"), 3, block_bytes=block_bytes, most_scores=most_scores).collect()
    assert len(found) <= 9 * 3 * 2
    of = {}
    for q, no, times in asked:
        of.setdefault(q, {})[no] = times
    for q, terms in of.items():
        want = sorted((-sum(w * terms.get(no, 0) for no, w in zip(v[3], v[4])), v[0]) for v in vectors)
        got = sorted((-r.score, r.document_id) for r in found if r.query_id == q)[:3]
        assert got == [x for x in want if x[0] < 0][:3]


def test_a_score_is_of_one_question(spark):
    chunks = as_chunks(text_windows(spark.createDataFrame(TEXTS, "doc_id long, text string")))
    index = scan_terms(chunks)
    alone = search_terms(index, spark.createDataFrame(ASKED[3:4], "query_id string, text string"), 5)
    among = search_terms(index, spark.createDataFrame(ASKED, "query_id string, text string"), 5).filter(F.col("query_id") == "q3")
    assert sorted((r.chunk_id, round(r.score, 9), r["rank"]) for r in alone.collect()) == sorted((r.chunk_id, round(r.score, 9), r["rank"]) for r in among.collect()) != []


@pytest.mark.parametrize("parts", [1, 3])
def test_a_scan_of_grams_finds_what_their_index_finds(spark, parts):
    odd = [(100, None), (101, ""), (102, "a"), (103, "É́tage été  été_9 x été"), (104, "the"), (105, "lone words here")]
    chunks = as_chunks(text_windows(spark.createDataFrame([*TEXTS, *odd], "doc_id long, text string")))
    asked = spark.createDataFrame([*ASKED, ("odd", "été été_9 lone words"), ("twice", "w12 w13 w12 w13")], "query_id string, text string")
    scan, index = scan_grams(chunks, parts=parts), index_grams(chunks)
    rows = [sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in search_grams(x, asked, 4).collect()) for x in (scan, index)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert scan.sizes().first() == (index.grams.count(), index.vocabulary.count())


def test_searches_by_grams_store_no_vectors(spark, sf_dir):
    corpus.BUILT.clear()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    for query in (corpus.tfidf_cosine_topk, corpus.corpus_fusion, corpus.search_index, corpus.search_comparison):
        assert query(spark, sf_dir).count() > 0
    made = {f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before}
    assert "norms" in made and not made & {"gram-counts", "gram-weights", "vocabulary", "postings"}
