"""Token counts against the libraries, and the cache: what is known is looked up, what is new is added once."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from folio.llm import queries, token_cache
from folio.llm.token_cache import CACHE_SCHEMA, TokenCounter, count_tokens

BYTES, WORDS, PIECES = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = ["", None, "a", "a", "A", " a", "one two  three\r\nfour", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "ÄÖ ü 漢字 \U0001f600\u0000", "  \n\n ", "word " * 9000, "z" * 40_000, "<s> </s> <unk>"]


@lru_cache(None)
def loaded(path: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def plain(path: str, text: str | None) -> int:
    if path.endswith(".json"):
        return len(loaded(path).encode(text or "", add_special_tokens=False).ids)
    return len(loaded(path).encode(text or ""))


def cached(spark, path: str) -> list:
    return spark.read.schema(CACHE_SCHEMA).parquet(path).collect()


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("most_sent", [token_cache.MOST_SENT, 0])
@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_same_as_the_library(spark, tmp_path, monkeypatch, path, most_sent):
    monkeypatch.setattr(token_cache, "MOST_SENT", most_sent)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(documents(spark, TEXTS), TokenCounter(path), str(tmp_path / "cache")).collect()}
    assert got == {k: (len((t or "").encode()), plain(path, t)) for k, t in enumerate(TEXTS)}
    assert len(cached(spark, str(tmp_path / "cache"))) == len({t or "" for t in TEXTS})


def test_only_misses_are_encoded_and_added(spark, tmp_path):
    cache, counter = str(tmp_path / "cache"), TokenCounter(BYTES)
    count_tokens(documents(spark, TEXTS[:6]), counter, cache).collect()
    first = {bytes(r.content): r.n_tokens for r in cached(spark, cache)}
    # a stored count that no encoder would give comes back: the text was not encoded again
    known = F.unhex(F.sha2(F.lit("known").cast("binary"), 256))
    spark.range(1).select(known.alias("content"), F.lit(777).cast("long").alias("n_tokens"), F.lit(counter.digest()).alias("tokenizer")).write.mode("append").partitionBy("tokenizer").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, [*TEXTS, "known"]), counter, cache).collect()}
    assert got[len(TEXTS)] == 777
    assert {k: got[k] for k in range(len(TEXTS))} == {k: plain(BYTES, t) for k, t in enumerate(TEXTS)}
    again = cached(spark, cache)
    count_tokens(documents(spark, TEXTS), counter, cache).collect()
    assert len(cached(spark, cache)) == len(again) == len({t or "" for t in TEXTS}) + 1 and first.items() <= {bytes(r.content): r.n_tokens for r in again}.items()


def test_tokenizers_do_not_mix(spark, tmp_path):
    cache = str(tmp_path / "cache")
    for path in (BYTES, WORDS):
        got = count_tokens(documents(spark, ["Some Words here"]), TokenCounter(path), cache).first()
        assert got.n_tokens == plain(path, "Some Words here")
    assert len({r.tokenizer for r in cached(spark, cache)}) == 2
    with pytest.raises(ValueError, match="json or [.]model"):
        TokenCounter("tokens.txt").library


def test_normal_form_joins_texts(spark, tmp_path):
    counter = TokenCounter(WORDS, normal=lambda c: F.lower(F.coalesce(c, F.lit(""))))
    got = count_tokens(documents(spark, ["SOME words", "some WORDS", None]), counter, str(tmp_path / "cache")).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == {(0, 10, 2), (1, 10, 2), (2, 0, 0)} and len(cached(spark, str(tmp_path / "cache"))) == 2


def test_a_cache_filled_twice_is_read_once(spark, tmp_path):
    cache, counter = str(tmp_path / "cache"), TokenCounter(BYTES)
    count_tokens(documents(spark, ["a b"]), counter, cache).collect()
    spark.read.schema(CACHE_SCHEMA).parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(f"{cache}-copy")
    spark.read.schema(CACHE_SCHEMA).parquet(f"{cache}-copy").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert len(cached(spark, cache)) == 2
    assert [r.n_tokens for r in count_tokens(documents(spark, ["a b", "a b"]), counter, cache).collect()] == [2, 2]


def test_odd_rows_and_names(spark, tmp_path):
    rows = [(1, "same", "p", 5, 1), (1, "same", "p", 5, 1), (None, "same", "p", 5, 2), (None, None, None, None, None), (1, "other text", "q", 6, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int, _content int")
    got = count_tokens(df, TokenCounter(BYTES), str(tmp_path / "cache"))
    assert got.columns == ["doc_id", "n_tokens", "n_bytes", "_content", "_n_bytes", "_n_tokens"]
    assert Counter(map(tuple, got.collect())) == Counter((i, p, n, c, len((t or "").encode()), plain(BYTES, t)) for i, t, p, n, c in rows)
    assert count_tokens(df.limit(0), TokenCounter(BYTES), str(tmp_path / "none")).count() == 0 and cached(spark, str(tmp_path / "none")) == []


def test_query_counts_every_document(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op12_token_counts(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = plain(BYTES, r.text)
        assert tuple(got[r.doc_id])[1:] == (len((r.text or "").encode()), n, n > 1024)
