"""BPE against the public library, and an exact round trip."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm.bpe import BpeVocabulary, Table, code_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "plain words", "  two  spaces\n\n\ttabs ", "it's we'll I'd", "naïve café 日本語 🙂", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", "12 345 x9", "%%% *** ###", "\x00\x01", "ab" * 20_000, "x" * 5_000, "\u00a0\u2003 x"]


@pytest.fixture(scope="module")
def ours():
    return BpeVocabulary(PATH)


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(ours, theirs, text):
    want = theirs.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert got.tolist() == want
    assert ours.decode_text(got) == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS[1:], ids=range(len(TEXTS) - 1))
def test_fixed_texts(ours, theirs, text):
    same(ours, theirs, text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("aeinorst ", max_size=60), st.lists(st.sampled_from(["th", "e ", "er", "ing", " <|endoftext|>", "'s", "\n", "  ", "é", "%"])).map("".join)))
def test_any_text(text):
    same(VOCABULARY, LIBRARY, text)


VOCABULARY, LIBRARY = BpeVocabulary(PATH), Tokenizer.from_file(PATH)


def test_memo_stays_bounded():
    t = Table(lambda k: k * 2, 3)
    assert [t[k] for k in range(10)] == [k * 2 for k in range(10)] and len(t) <= 3


def test_documents(spark, theirs):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", "x")], "doc_id long, text string, n_tokens string")
    rows = code_documents(docs, PATH, keep=("ids", "decoded")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == ids and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert code_documents(docs.filter("false"), PATH).count() == 0


def test_decoding_in_slices(ours):
    text = "Añ €𝄞 words " * 50
    ids = ours.encode(text)
    assert ours.decode(ids, most=1) == ours.decode(ids, most=7) == ours.decode(ids) == text.encode()
