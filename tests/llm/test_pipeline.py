"""The pipeline against plain versions of its stages, and its stages on odd tables."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from folio.llm import sql
from folio.llm.decontaminate import plain
from folio.llm.near_copies import NEAR
from tests.llm.test_search import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    names = [*__spark_entry__.queries()]
    assert "pipeline" in names and [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_follow_from_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).persist()
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == columns
        left = {r.doc_id: r.text for r in out.collect()}
        assert all(kept[i] == t for i, t in left.items())
        if name == "near_copies":
            assert {*left} == {i for i, (_, c) in brute(kept.items(), NEAR.words, NEAR.percent).items() if i == c}
        if name == "benchmark":
            items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(x in plain(t) for t in left.values() for x in items)
        docs, kept = out, left
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        assert r.ids == theirs.encode(kept[r.doc_id], add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "x " * 30_000, None, "s", None)]], ids=["empty", "odd"])
def test_odd_tables(spark, sf_dir, rows):
    clashes = ("toxicity", "toxicity_score", "quality_score", "_feature_words", "_t", "_gone", "matches", "row", "f", "component_id", "a.b")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"my {c}") for c in clashes})
    for name, stage in corpus_pipeline.STAGES:
        try:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= len(rows)
            if name != corpus_pipeline.STAGES[-1][0]:  # all but the last return the input's columns as they are
                assert out.columns == docs.columns and all(r[c] == f"my {c}" for r in out.collect() for c in clashes)
        except Exception as e:  # name the stage in the report
            raise AssertionError(name) from e


def plain_rows(df):
    return sorted((tuple("" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = spark.createDataFrame(c.execute(sql.oracle_sql()[name]).fetchdf().astype(object).where(lambda d: d.notna(), None), got.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
