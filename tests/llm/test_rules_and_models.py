"""Quality rules, quality model and toxicity: exact bounds, held-out accuracy, edge cases."""

from __future__ import annotations

import math
from math import comb
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm.quality_model import COLUMNS, features, fit_quality, score_quality, train
from folio.llm.quality_rules import Risk, binomial_tail, document_statistics, judge_quality, thresholds
from folio.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity
from folio.llm.toxicity import train as train_toxicity

SMALL = "/root/testdata/sf0.01"
EDGES = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "word", "de"), (5, "a b c d e a b c d e", "en"), (5, "a b c d e a b c d e", "en"), (6, "x " * 30_000, "en"), (None, "no id", "fr"), (7, "l1 a\nl1 a\n\nl2", "en")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, g, 9, 0.5, 1.0) for i, t, g in EDGES], "doc_id long, text string, lang string, n_words int, toxicity double, word_length double")


def repeats(words: list[str]) -> int:
    seen: dict[tuple, list[int]] = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    return len({i for ks in seen.values() if len(ks) > 1 for k in ks for i in range(k, k + 5)})


def test_statistics(spark, edges):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in document_statistics(edges).collect())
    want = []
    for i, t, _ in EDGES:
        w = (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        want.append((-1 if i is None else i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeats(w)))
    assert got == sorted(want)


def test_repeat_words_match_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in document_statistics(docs).collect():
        assert r.n_repeat_words == repeats(texts[r.doc_id].split()), r.doc_id


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for n in (1, 7, 50, 400) for p in (0.01, 0.05, 0.3) for k in range(0, int(n * p) + 1) if k < n * p]
    for p in (0.01, 0.05, 0.3):
        rows = spark.createDataFrame([(n, k) for n, k, q in cases if q == p], "n long, k long")
        for r in rows.select("n", "k", binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            assert math.isclose(r.t, sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)), rel_tol=1e-9)


def test_thresholds_hold_their_risk(spark):
    rows = [(k, "en", 100, 400 + (k % 1000 == 0) * 900, 0, 0, 0, 0) for k in range(5_000)] + [(10_000 + k, "de", 100, 400, 0, 0, 0, 0) for k in range(20)]
    stats = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long")
    labels = spark.createDataFrame([(k, 1) for k in range(20_000)], "doc_id long, quality int")
    cuts = {r.of_stratum: r for r in thresholds(stats, labels, Risk(risk=0.02)).collect()}
    assert cuts["en"].word_length_cut == 8.0 and cuts["en"].symbol_rate_cut == 0.05
    assert cuts["de"].word_length_cut is None  # twenty labels prove nothing
    # a document that repeats is one trial
    twice = stats.unionByName(stats).unionByName(stats)
    assert sorted(thresholds(twice, labels, Risk(risk=0.02)).collect(), key=str) == sorted(thresholds(stats, labels, Risk(risk=0.02)).collect(), key=str)
    judged = judge_quality(stats, labels, Risk(risk=0.02))
    assert judged.filter("not kept").count() == 5 and judged.filter("not kept and stratum = 'de'").count() == 0


def test_all_rules_together_hold_the_risk(spark):
    """Five rules that each reject other documents: no one of them may take the whole risk."""
    names = ("n_symbols", "n_marks", "word_chars", "n_dup_lines", "n_repeat_words")
    rows = []
    for k in range(20_000):
        v = dict.fromkeys(names, 0) | {"word_chars": 400}
        if k % 1000 < 75:  # each rule alone would reject 1.5 %, all together 7.5 %
            v[names[k % 5]] = 1600 if names[k % 5] == "word_chars" else 18
        rows.append((k, "en", 100, *(v[n] for n in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks"))))
    stats = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long")
    labels = spark.createDataFrame([(k, 1) for k in range(20_000)], "doc_id long, quality int")
    assert judge_quality(stats, labels, Risk(risk=0.02)).filter("not kept").count() <= 400


def test_statistics_are_computed_once(spark, edges):
    """Thresholds over statistics that were not stored: their plan holds no more window hashes than the statistics' own."""
    plan = thresholds(document_statistics(edges), spark.createDataFrame([], "doc_id long, quality int"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") <= 2


def test_rules_edge_cases(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    stats = document_statistics(edges)
    got = judge_quality(stats, labels).collect()
    assert len(got) == len(EDGES) and all(r.base_failed or r.kept for r in got)
    assert judge_quality(stats.filter("false"), labels).count() == 0


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (order[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()


def labelled(spark, column, sf_dir=SMALL):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("doc_id", "text", column)
    return rows, spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_on_held_out(spark):
    rows, labels = labelled(spark, "quality")
    model = fit_quality(rows.drop("quality"), labels)
    found = score_quality(rows, model).select("doc_id", "quality", "quality_score").toPandas()
    held = found[[crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]]
    assert auc(held.quality_score.to_numpy(), held.quality.to_numpy()) > 0.9
    # the compiled column gives what numpy gives
    x = features(rows).orderBy("doc_id").select(*COLUMNS).toPandas().to_numpy(float)
    assert np.allclose(model.score(x), found.sort_values("doc_id").quality_score, atol=1e-9)
    assert 0 < len(model.rules) < 200


def test_toxicity_on_held_out(spark):
    rows, labels = labelled(spark, "toxic", "/root/testdata/sf0.1")
    found = score_toxicity(rows, fit_toxicity(rows.drop("toxic"), labels)).toPandas()
    held = found[[crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]]
    assert auc(held.toxicity.to_numpy(), held.toxic.to_numpy()) > 0.9
    assert ((held.toxicity >= 0.5) == held.toxic).mean() > 0.95


def test_toxicity_knows_misspellings():
    bad, good = ["idiot", "moron", "worthless"], "the of and in there water house garden letter winter".split()
    rng = np.random.default_rng(1)
    texts, y = [], []
    for k in range(600):
        words = list(rng.choice(good, 30))
        if k % 2:
            words[int(rng.integers(30))] = str(rng.choice(bad))
        texts.append(" ".join(words))
        y.append(k % 2)
    model = train_toxicity(texts, y)
    clean = " ".join(good * 5)
    assert model.score(clean) < 0.5
    for word in ("idiiot", "idiots", "morron", "worthles"):
        assert model.score(f"{clean} {word} {clean}") > 0.5, word
    again = ToxicityModel(model.weights, model.bias, model.shape)
    assert again.score("idiot") == model.score("idiot")


@pytest.mark.parametrize("given", [[], [0], [1]])
def test_models_without_both_classes(spark, edges, given):
    labels = spark.createDataFrame([(4, v, v) for v in given] + [(5, None, None)], "doc_id long, quality int, toxic int")
    quality = score_quality(edges, fit_quality(edges, labels)).collect()
    toxic = score_toxicity(edges, fit_toxicity(edges, labels), "t").collect()
    assert len(quality) == len(toxic) == len(EDGES)
    assert {round(r.quality_score, 6) for r in quality} == {0.0 if given == [0] else 1.0}
    assert {round(r.t, 6) for r in toxic} == {1.0 if given == [1] else 0.0}
    assert {r.toxicity for r in toxic} == {0.5} and {r.word_length for r in quality} == {1.0}
    for scored in (lambda d: score_toxicity(d, fit_toxicity(edges, labels), "Lang"), lambda d: score_quality(d, fit_quality(edges, labels), "lang")):
        with pytest.raises(ValueError):
            scored(edges)
    assert score_quality(edges.filter("false"), train(np.zeros((0, 12)), [])).count() == 0


def test_a_scorer_works_out_each_gram_and_word_of_some_megabytes_once():
    from folio.llm import toxicity

    model, seen = toxicity.ToxicityModel(np.zeros(1 << 18), 0.0, toxicity.Shape()), []
    made = model.words.made
    model.words.made = lambda w: seen.append(w) or made(w)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:8]]  # 140,608
    for _ in range(2):
        model.logit(" ".join(words))
    assert len(seen) == len(words)
