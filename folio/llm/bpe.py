"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A piece of text is encoded by taking the longest token that an Aho-Corasick automaton finds at each position. A choice
stands only if it and the token before form a compatible pair, that is, if the merges would give just these two tokens
for their joined bytes; else the next shorter token is tried, then the token before is taken back. Every position and
length is tried once at most, so the work is linear in the piece, and the ids are those that the merges give.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import regex

from folio.llm.common import small_batches

#: How the vocabulary's text is cut before merges; fixed with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Table(dict):
    """A memo of a function with ``most`` keys, so a worker's memory stays bounded.

    When it is full its keys become the ones ``before``, from which those that come again are taken back; so common keys
    stay, and at most ``most`` more are held.
    """

    def __init__(self, made: Callable, most: int) -> None:
        super().__init__()
        self.made, self.most, self.before = made, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.most:
            self.before = dict(self)
            super().clear()
        self[key] = value
        return value

    def keep(self, most: int) -> None:
        """Forgets all but the ``most`` keys that came first, which are mostly common ones."""
        kept = dict(islice(self.items(), most))
        self.clear()
        self.update(kept)
        self.before = {}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class BpeVocabulary:
    """Tokens, merges and tables of a byte-level vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocabulary.values(), *self.added.values()) + 1
        #: What decoding writes for each id.
        self.bytes_of = [b""] * size
        for text, i in vocabulary.items():
            self.bytes_of[i] = text.encode() if text in self.added else bytes(letters[c] for c in text)
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.id_of = {bytes(letters[c] for c in text): i for text, i in vocabulary.items() if text not in self.added}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: The two tokens that the merges make a token of; a single byte stands for itself.
        self.split = {i: (i, i) for b, i in self.id_of.items() if len(b) == 1}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = vocabulary[a], vocabulary[b]
            made = vocabulary[a + b]
            self.rank[left, right] = (r, made)
            self.split.setdefault(made, (left, right))
        #: The rank of the merge that makes each token; a single byte comes before all.
        self.born = {made: r for pair, (r, made) in self.rank.items() if self.split[made] == pair}
        for i in {i for b, i in self.id_of.items() if len(b) == 1}:
            self.born[i] = -1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in self.id_of.items():
            if i in self.born:
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix of each token, else -1.
        self.shorter = [-1] * size
        for b, i in self.id_of.items():
            if i in self.born:
                self.shorter[i] = next((self.id_of[b[:k]] for k in range(len(b) - 1, 0, -1) if self.id_of.get(b[:k]) in self.born), -1)
        self.size_of = list(map(len, self.bytes_of))
        #: The pair-compatibility table, filled as pairs are met.
        self.pairs = Table(lambda key: self.compatible(key >> 32, key & 0xFFFFFFFF), 1 << 18)
        #: The ids of pieces, packed.
        self.pieces = Table(lambda piece: packed(self.encode_bytes(piece.encode())), 1 << 17)

    @cached_property
    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, and where each begins."""
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum([0, *map(len, self.bytes_of)])

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are when they stand side by side.

        Walks both tokens back through the merges that made them: at each step the last merge is undone, and no merge
        across the border may come before it.
        """
        limit = float("inf")
        while True:
            across = self.rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            born_left, born_right = self.born[left], self.born[right]
            if born_left > born_right:
                # the left token's last merge is undone; an equal rank across the border would come after it
                limit = born_left
                left = self.split[left][1]
            elif born_right < 0:
                return True
            else:
                # merges of one rank are made from left to right, so an equal one across the border comes first
                limit = born_right + 1
                right = self.split[right][0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        known = self.id_of.get(data, -1)
        if known in self.born:
            return [known]
        n, size_of, pairs, shorter = len(data), self.size_of, self.pairs, self.shorter
        letters = data.decode("latin-1")
        # most pieces are done by the longest token at each border, one after another
        out: list[int] = []
        at, previous = 0, -1
        for end, token in self.automaton.iter_long(letters):
            if end + 1 - size_of[token] != at or (previous >= 0 and not pairs[previous << 32 | token]):
                break
            out.append(token)
            previous, at = token, end + 1
        if at == n:
            return out
        # else a shorter token has to be found for the first that did not fit; tokens already taken are mostly left alone, so
        # matches are looked for from there on, and from the beginning only if one is taken back
        longest, known_from = [-1] * n, at
        for end, i in self.automaton.iter(letters, at):
            longest[end + 1 - size_of[i]] = i  # of tokens from one position, the longest ends last
        dead = bytearray(n + 1)  # positions from which no valid way on exists
        token = longest[at]
        while at < n:
            while token >= 0:
                end = at + size_of[token]
                if not dead[end] and (previous < 0 or pairs[previous << 32 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                previous, at = token, end
                if at < n:
                    token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
                token = shorter[token]
                if at < known_from:
                    known_from = 0
                    for end, i in self.automaton.iter(letters):
                        longest[end + 1 - size_of[i]] = i
                previous = out[-1] if out else -1
        return out

    @cached_property
    def cutter(self) -> regex.Pattern:
        return regex.compile(PIECES)

    @cached_property
    def fence(self) -> regex.Pattern | None:
        """Matches the added tokens, longest first."""
        words = sorted(self.added, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, words)) + ")") if words else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as little-endian unsigned 32-bit integers; an added token's own text is that token."""
        parts = self.fence.split(text) if self.fence else [text]
        out: list[bytes] = []
        for part in parts:
            if part in self.added:
                out.append(packed([self.added[part]]))
            elif part:
                cut = self.cutter.findall(part)
                if len(max(cut, key=len)) > 64:
                    # a long piece would hold much of the table and seldom comes again
                    out += (self.pieces[piece] if len(piece) <= 64 else packed(self.encode_bytes(piece.encode())) for piece in cut)
                else:
                    out += map(self.pieces.__getitem__, cut)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray, most: int = 1 << 16) -> bytes:
        """Bytes of ``ids``, at most ``most`` at once, so that a long text needs no more than its own bytes beside."""
        return b"".join(self.gathered(ids[at : at + most]) for at in range(0, len(ids), most))

    def gathered(self, ids: np.ndarray) -> bytes:
        """Bytes of ``ids``: one gather over the token bytes, with places worked out from the offset table."""
        buffer, starts = self.offsets
        first = starts[ids]
        sizes = starts[ids.astype(np.int64) + 1] - first
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        return buffer[np.arange(total) + np.repeat(first - (ends - sizes), sizes)].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BpeVocabulary:
    """One vocabulary a Python worker, kept from batch to batch."""
    return BpeVocabulary(path)


#: Rows of a batch that are coded at once, so a worker holds the ids of these only.
SLICE_ROWS = 256


def code_documents_batches(path: str, keep: tuple[str, ...]):
    """A function over Arrow batches: id and text in, id, counts, digests and what is kept of ``ids`` and ``decoded`` out."""
    import hashlib

    import pyarrow as pa

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            counts, id_digests, text_digests, ids_out, texts = [], [], [], [], []
            for text in batch.column(1):
                ids = v.encode(text.as_py() or "")
                back = v.decode_text(ids)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(back.encode()).hexdigest())
                if "ids" in keep:
                    ids_out.append(ids.astype("<i4"))
                if "decoded" in keep:
                    texts.append(back)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if "ids" in keep:
                starts = np.cumsum([0, *counts]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(ids_out))))
            if "decoded" in keep:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *(k for k in ("ids", "decoded") if k in keep)])
        # a worker lives on after its task; beside the fixed tables, pairs and common pieces stay with it
        v.pieces.keep(1 << 15)
        v.pairs.keep(1 << 17)

    return coded


def code_documents(docs, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()):
    """One row per document: id, n_tokens, digests of its ids and of the text they decode to; ``keep`` may name ``ids`` and ``decoded``.

    A null or empty text has no tokens; repeated rows repeat; an empty table stays empty; other columns are ignored.
    No shuffle: documents are coded where they are read, whole, in bounded batches.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    return docs.select(id_col, text_col).mapInArrow(code_documents_batches(path, keep), schema).withColumnRenamed("id", id_col)
