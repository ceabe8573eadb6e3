"""The memo of pieces keeps what comes again, and pieces done by longest tokens are those that the library gives."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from folio.llm.bpe import BpeVocabulary, Table


def test_common_keys_are_not_made_again_when_the_memo_is_full():
    made = []
    t = Table(lambda k: made.append(k) or k + 1, 4)
    for k in range(100):
        assert t[-1] == 0 and t[k] == k + 1
        assert len(t) <= 4 and len(t.before) <= 4
    assert made.count(-1) == 1
    t.keep(2)
    assert len(t) <= 2 and not t.before
    assert t[-1] == 0 and t[99] == 100


def test_false_values_are_kept():
    made = []
    t = Table(lambda k: bool(made.append(k)), 2)
    assert [t[k] for k in (1, 2, 3, 1, 1)] == [False] * 5 and made == [1, 2, 3]


def test_words_of_syllables():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = BpeVocabulary(path), Tokenizer.from_file(path)
    parts = ["ment", "tion", "er", "ing", "ci", "ungs", "é", "ste", "q", "日"]
    for a in parts:
        for b in parts:
            for c in parts:
                text = f" {a}{b}{c} {c}{a}{b}{c}"
                assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
