"""Benchmark decontamination by the q-gram lemma.

Benchmark items are the queries, in blocks of bounded size; every document is searched for regions that match a whole
item within its edit budget. If a region of a text matches an item of m characters with at most k edits, the two share
at least m - q + 1 - k * q q-grams, and these lie on neighbouring diagonals (position in the text less position in the
item), at most 2k + 1 of them. So shared q-grams are counted per item and band of diagonals, bands overlapping by half;
bands that reach the lemma's bound are candidates, and a banded alignment decides.

An item for which the lemma's bound would fall under one gets shorter q-grams, so the declared budget holds for all items;
items shorter than a q-gram have no edits and are found as they are.

Texts are compared in a plain form: lower case, each run of other than letters and digits one space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import scratch, small_batches, unused, written

PLAIN = re.compile(r"[\W_]+")
MATCHES = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"


@dataclass(frozen=True)
class Budget:
    """``q``: longest q-gram. ``edit_rate``: edits allowed per character of an item, under a half. ``block_chars``: characters of benchmark text in one block."""

    q: int = 8
    edit_rate: float = 0.1
    block_chars: int = 1_000_000

    def edits(self, size: int) -> int:
        """Edits allowed for an item of ``size`` characters; the rate counts as a decimal, so a tenth of 30 is 3."""
        return int(Fraction(str(self.edit_rate)) * size)

    def gram(self, size: int) -> int:
        """The longest q-gram, up to q, of which a match of an item of ``size`` characters must share one; q if it has no edits."""
        edits = self.edits(size)
        return max(1, min(self.q, size // (edits + 1))) if edits else self.q


def plain(text: str | None) -> str:
    return PLAIN.sub(" ", (text or "").lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position, by doubling: hashes of a and b characters make those of a + b."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, size = c.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1), 1
    out, done = None, 0
    power = {1: np.array([0x9E3779B97F4A7C15], np.uint64)}  # arrays wrap around without a warning
    while True:
        if q & size:
            if out is None:
                out, done = h, size
            else:
                n = len(c) - done - size + 1
                out = out[:n] * power[size] + h[done : done + n]
                done += size
        if size * 2 > q:
            break
        n = len(c) - 2 * size + 1
        h = h[:n] * power[size] + h[size : size + n]
        power[2 * size] = power[size] * power[size]
        size *= 2
    return out ^ (out >> np.uint64(29))


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end in the text) of the best match of the whole item that begins on diagonals low to high, within ``most`` edits.

    Cells are kept by diagonal, with ``most`` diagonals more on either side; both ends of the text are free.
    """
    low, high = low - most, high + most
    width = high - low + 1
    inf = 1 << 20
    steps = np.arange(width)
    at = low + steps
    row = np.where((at >= 0) & (at <= len(text)), 0, inf)
    padded = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)  # no character
    left = max(0, -low)
    part = text[max(0, low) : max(0, low + len(item) + width)]
    padded[left : left + len(part)] = part[: len(padded) - left]
    for i in range(len(item)):
        take = row + (padded[i : i + width] != item[i])
        take[:-1] = np.minimum(take[:-1], row[1:] + 1)
        j = at + i + 1  # columns of this row
        take[(j < 0) | (j > len(text))] = inf
        row = np.minimum.accumulate(take - steps) + steps
        if i % 8 == 7 and row.min() > most:
            return None
    best = int(row.argmin())
    return (int(row[best]), min(len(text), int(at[best] + len(item)))) if row[best] <= most else None


class Index:
    """A block of items: one q-gram index for each length of q-grams that its items need, nearly always one."""

    def __init__(self, items: Sequence[tuple[int, str]], b: Budget) -> None:
        by_gram: dict[int, list[tuple[int, str]]] = {}
        for i, t in items:
            by_gram.setdefault(b.gram(len(plain(t))), []).append((i, t))
        self.blocks = [Block(held, replace(b, q=q)) for q, held in sorted(by_gram.items())]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        p = plain(text)
        return sorted(m for block in self.blocks for m in block.matches(p))


class Block:
    """Q-gram index of items of which every match shares a q-gram; items shorter than one have no edits."""

    def __init__(self, items: Sequence[tuple[int, str]], b: Budget) -> None:
        self.b = b
        self.ids = [i for i, _ in items]
        self.texts = [plain(t) for _, t in items]
        self.codes = [codes(t) for t in self.texts]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([b.edits(int(n)) for n in sizes], np.int64)
        self.bound = sizes - b.q + 1 - self.edits * b.q
        #: How far from its first gram an item's match may end.
        self.reach = int(sizes.max(initial=0) + 2 * self.edits.max(initial=0) + 2)
        #: Items shorter than a q-gram are found as they are.
        self.short = [k for k, n in enumerate(sizes) if 0 < n < b.q]
        hashes = [gram_hashes(c, b.q) for c in self.codes]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, np.bool_)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, p: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits), the best region of each item in a plain text, in its positions; start is approximate by the edits."""
        found = [(self.ids[k], at, at + len(self.texts[k]), 0) for k in self.short if (at := f" {p} ".find(f" {self.texts[k]} ")) >= 0]
        c = codes(p)
        h = gram_hashes(c, self.b.q)
        hits = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        if len(hits) and len(self.grams):
            slot = np.minimum(np.searchsorted(self.grams, h[hits]), len(self.grams) - 1)
            true = self.grams[slot] == h[hits]
            hits, slot = hits[true], slot[true]
        if len(hits) and len(self.grams):
            best: dict[int, tuple[int, int]] = {}
            for k, low, high in self.bands(hits, slot):
                if best.get(k, (1, 0))[0] == 0:
                    continue
                at = p.find(self.texts[k], max(0, low), max(0, high + 1 + len(self.texts[k])))
                got = (0, at + len(self.texts[k])) if at >= 0 else banded_edits(self.codes[k], c, low, high, int(self.edits[k]))
                if got and (k not in best or got < best[k]):
                    best[k] = got
            found += [(self.ids[k], max(0, end - len(self.codes[k])), end, edits) for k, (edits, end) in best.items()]
        return sorted(found)

    def bands(self, hits: np.ndarray, slot: np.ndarray, most_pairs: int = 4_000_000) -> Iterator[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of bands that reach the bound. Positions are taken in overlapping stretches, so a long text needs no more memory."""
        counts = self.count[slot]
        begin = 0
        while begin < len(hits):
            total = np.cumsum(counts[begin:])
            stop = begin + max(1, int(np.searchsorted(total, most_pairs)))
            if stop < len(hits):  # go on at least one item's length past the start
                stop = max(stop, int(np.searchsorted(hits, hits[begin] + 2 * self.reach)))
            yield from self.bands_of(hits[begin:stop], slot[begin:stop])
            if stop >= len(hits):
                return
            begin = max(begin + 1, int(np.searchsorted(hits, hits[stop - 1] - self.reach)))

    def bands_of(self, hits: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, int]]:
        n = self.count[slot]
        ends = np.cumsum(n)
        index = np.repeat(self.first[slot] - (ends - n), n) + np.arange(ends[-1])
        item = self.owner[index]
        total = np.bincount(item, minlength=len(self.ids))
        enough = total >= self.bound
        keep = enough[item]
        if not keep.any():
            return
        item, place, at = item[keep], self.place[index][keep], np.repeat(hits, n)[keep]
        diagonal = at - place
        width = 2 * self.edits[item] + 1
        # half bands; each neighbouring two make a band, so any 2k + 1 diagonals lie in one
        half = diagonal // width
        key = (item.astype(np.int64) << 40) + (half + (1 << 30))
        order = np.argsort(key, kind="stable")
        keys, start, number = np.unique(key[order], return_index=True, return_counts=True)
        after = np.zeros(len(keys), np.int64)
        if len(keys) > 1:
            after[:-1] = np.where(keys[1:] == keys[:-1] + 1, number[1:], 0)
        before = np.zeros(len(keys), np.int64)
        if len(keys) > 1:
            before[1:] = np.where(keys[1:] == keys[:-1] + 1, number[:-1], 0)
        items = keys >> 40
        alone = (number + after >= self.bound[items]) | ((before == 0) & (number >= self.bound[items]))
        for i in np.flatnonzero(alone):
            k = int(items[i])
            pairs = order[start[i] : start[i] + number[i] + after[i]]
            # grams that a match shares stand at as many places of the item, and of the text; repeats of one gram do not count
            if min(len(np.unique(place[pairs])), len(np.unique(at[pairs]))) >= self.bound[k]:
                w = int(2 * self.edits[k] + 1)
                low = (int(keys[i] & ((1 << 40) - 1)) - (1 << 30)) * w
                yield k, low, low + 2 * w - 1


def item_blocks(benchmark: DataFrame, b: Budget) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_chars`` characters (or one item), brought to the driver a block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        if block and size + len(row.text) > b.block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def searched(block: Broadcast, b: Budget) -> Callable[[Column], Column]:
    """A column function: the matches of a text among one block's items. A worker builds the index once a task."""

    @F.pandas_udf(MATCHES)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(block.value, b)
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(("item_id", "start", "end", "edits"), m)) for m in index.matches(t)], na_action=None)

    return matches


def found_in(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", b: Budget = Budget()) -> DataFrame:
    """``docs`` with ``out``, a free name: the matches of each whole text, an array of (item_id, start, end, edits), sorted.

    One block of items is one narrow pass over the texts, with one broadcast index of bounded size. Of several blocks each
    is a pass of its own, whose few hits are written; a task never holds more than one block's index. Hits then meet their
    texts by digest, so documents are shuffled only if there are too many hits to broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, passes, last = scratch(spark, "contamination"), [], None
    for block in item_blocks(benchmark, b):
        if last is not None:
            passes.append(hits_of(docs, last, text_col, b, f"{folder}/{len(passes)}"))
        last = sorted(block)
    if last is None:
        return docs.withColumn(out, F.array().cast(MATCHES))
    if not passes:
        return docs.withColumn(out, searched(spark.sparkContext.broadcast(last), b)(F.col(text_col)))
    passes.append(hits_of(docs, last, text_col, b, f"{folder}/{len(passes)}"))
    every = spark.read.schema(passes[0].schema).parquet(*(f"{folder}/{k}" for k in range(len(passes))))
    digest, hits = unused(docs, "digest"), unused(docs, "hits")
    every = every.groupBy(F.col("digest").alias(digest)).agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias(hits))
    every = written(every, f"{folder}/all")
    if every.limit(MOST_HITS + 1).count() <= MOST_HITS:
        every = F.broadcast(every)
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    met = docs.join(every, key == F.col(digest), "left")
    return met.select(*columns, F.coalesce(hits, F.array().cast(MATCHES)).alias(out))


#: Texts with a match up to which they are broadcast.
MOST_HITS = 100_000


def hits_of(docs: DataFrame, block: list[tuple[int, str]], text_col: str, b: Budget, path: str) -> DataFrame:
    """(digest, matches) of the texts with a match in ``block``, each text once, written."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    found = docs.select(F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"), searched(sent, b)(F.col(text_col)).alias("matches"))
    hits = written(found.filter(F.size("matches") > 0).dropDuplicates(["digest"]), path)
    sent.unpersist()
    return hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, b: Budget = Budget(), out: str = "matches") -> DataFrame:
    """``docs`` with a column ``out``, the matches of each whole text among the benchmark's items; see found_in.

    A null or empty text matches nothing, an empty or null item is found nowhere, an item given twice counts once, and
    an empty benchmark matches nothing. Of equally good regions the first counts. Repeated rows repeat, an empty table
    stays empty, all columns of the input are kept; a clash with ``out`` raises ValueError, unused() finds a free name.
    """
    if unused(docs, out) != out:
        raise ValueError(f"docs has a column {out}")
    return found_in(docs, benchmark, out, "text", b)


def decontaminated(docs: DataFrame, benchmark: DataFrame, b: Budget = Budget()) -> DataFrame:
    """The documents in which no item is found, unchanged; cases as in find_contamination."""
    name = unused(docs, "matches")
    return found_in(docs, benchmark, name, "text", b).filter(F.size(name) == 0).drop(name)
