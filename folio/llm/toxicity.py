"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and its whole form, hashed to buckets; misspellings share most n-grams with
the word they spell. A word's subword embeddings are averaged, a span's words likewise, and the mean goes to a
two-class softmax. A document is read
in overlapping spans of a few words, and its logit is that of its most toxic span, so one passage is not diluted by a
long clean text. Embeddings and softmax weights are trained together on labelled documents.

Once trained, each bucket's embedding meets the softmax weights only through one product, so scoring needs one number
a bucket: a span's logit is the mean of its buckets' numbers. This is the same model, not an approximation.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches, unused

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 18
    dim: int = 8
    least_gram: int = 3
    most_gram: int = 5
    span: int = 2
    epochs: int = 8
    rate: float = 0.5
    decay: float = 1e-5
    least_docs: int = 3
    balance: float = 0.5
    seed: int = 7


class Memo(dict):
    """A function's results by key, emptied when there are ``most``, so a worker's memory stays bounded."""

    def __init__(self, made: Callable, most: int) -> None:
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, key):
        value = self.made(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def grams_of(word: str, shape: Shape) -> list[str]:
    """Subwords of a lower-case word: its character n-grams between borders, and the whole."""
    framed = f"<{word}>"
    n = len(framed)
    return [framed] + [framed[k : k + size] for size in range(shape.least_gram, min(shape.most_gram, n - 1) + 1) for k in range(n - size + 1)]


def bucket(gram: str, shape: Shape) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % shape.buckets


def windowed(values: np.ndarray, span: int) -> np.ndarray:
    """Sums over each window of ``span`` values, or of all when there are fewer."""
    total = np.concatenate([[0], np.cumsum(values)])
    span = min(span, len(values))
    return total[span:] - total[:-span]


#: Grams and words whose numbers a scoring worker keeps: texts of some megabytes have more than 65,536 grams.
MOST_KEPT = 1 << 18


class ToxicityModel:
    """``weights``: one number a bucket; ``bias``: the softmax's."""

    def __init__(self, weights: np.ndarray, bias: float, shape: Shape) -> None:
        self.weights, self.bias, self.shape = weights.astype(np.float32), float(bias), shape
        gram = Memo(lambda g: float(self.weights[bucket(g, shape)]), MOST_KEPT)

        def word(w: str) -> float:
            grams = grams_of(w, shape)
            return sum(map(gram.__getitem__, grams)) / len(grams)

        #: Mean of a word's bucket weights.
        self.words = Memo(word, MOST_KEPT)

    def logit(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        if not words:
            return self.bias
        values = np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))
        return float(windowed(values, self.shape.span).max()) / min(self.shape.span, len(words)) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -500, 500))))


#: A text's distinct words, and its distinct spans as rows of places among them; -1 fills up the only span of a shorter text.
Bag = tuple[Sequence[str], np.ndarray]


def bag_of(text: str | None, span: int) -> Bag:
    """What training needs of a text, whatever its length: each word and each span once, in the order in which they come."""
    index: dict[str, int] = {}
    at = np.array([index.setdefault(w, len(index)) for w in WORD.findall((text or "").lower())], np.int32)
    if len(at) < span:
        spans = np.full((min(1, len(at)), span), -1, np.int32)
        spans[:, : len(at)] = at
        return list(index), spans
    spans = np.lib.stride_tricks.sliding_window_view(at, span)
    _, first = np.unique(spans, axis=0, return_index=True)
    return list(index), spans[np.sort(first)]


def train(texts: Sequence[str | None], toxic: Sequence[int], shape: Shape = Shape()) -> ToxicityModel:
    return train_bags((bag_of(t, shape.span) for t in texts), list(toxic), shape)


def spread_out(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in a row."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def train_bags(bags: Iterable[Bag], toxic: list[int], shape: Shape = Shape()) -> ToxicityModel:
    """From ``bags``, read once and held as numbers; ``toxic`` may fill as they are read. Adagrad over documents in random order, each step through the span that scores highest now; the later epochs' logits are averaged.

    Without rows of both classes there is nothing to learn: the score is then 0 for all texts, or 1 if every row is toxic.
    """
    rng = np.random.default_rng(shape.seed)
    index: dict[str, int] = {}
    words: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    for held, spans in bags:
        words.append(np.array([index.setdefault(w, len(index)) for w in held], np.int32))
        docs.append(np.where(spans >= 0, words[-1][spans], -1) if len(held) else spans)
    y = np.asarray(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(shape.buckets), -500.0 if not len(y) or y[0] == 0 else 500.0, shape)
    places = Memo(lambda g: bucket(g, shape), 1 << 16)
    buckets, counts = array("i"), array("i")
    for w in index:
        grams = grams_of(w, shape)
        counts.append(len(grams))
        buckets.extend(map(places.__getitem__, grams))
    places.clear()
    index.clear()
    flat, counts = np.array(buckets, np.int32), np.array(counts, np.int64)
    del buckets
    starts = np.concatenate([[0], np.cumsum(counts)])
    full = [k for k in range(len(docs)) if len(docs[k])]
    # a bucket that few documents have says more of those than of any word; it counts in a mean, but stays at zero
    spread = np.zeros(shape.buckets, np.int64)
    for w in words:
        if len(w):
            spread[np.unique(flat[spread_out(starts[w], counts[w])])] += 1
    held = spread >= shape.least_docs
    embeddings = rng.uniform(-0.5 / shape.dim, 0.5 / shape.dim, (shape.buckets, shape.dim))
    embeddings *= held[:, None]
    softmax = rng.normal(0, 1, (2, shape.dim))
    bias = np.zeros(2)
    seen_e, seen_w, seen_b = np.full(shape.buckets, 1e-2), np.full(2, 1e-2), np.full(2, 1e-2)
    share = y[full].mean()
    weight = np.where(y == 1, (0.5 / share) ** shape.balance, (0.5 / (1 - share)) ** shape.balance)
    folded, shift = np.zeros(shape.buckets), 0.0
    for epoch in range(shape.epochs):
        order = rng.permutation(full)
        for batch in np.array_split(order, max(1, len(order) // 128)):
            direction = softmax[1] - softmax[0]
            used = np.unique(np.concatenate([words[k] for k in batch]))
            sizes = counts[used]
            per_gram = embeddings[flat[spread_out(starts[used], sizes)]] @ direction
            value = np.zeros(len(counts) + 1)  # the last one stands for -1
            value[used] = np.add.reduceat(per_gram, np.cumsum(sizes) - sizes) / sizes
            rows, owner, share_of = [], [], []
            for n, k in enumerate(batch):
                spans = docs[k]
                inside = spans[int(np.argmax(value[spans].sum(1)))]
                inside = inside[inside >= 0]
                rows.append(flat[spread_out(starts[inside], counts[inside])])
                owner.append(np.full(len(rows[-1]), n))
                share_of.append(np.repeat(1 / (counts[inside] * len(inside)), counts[inside]))
            rows_, owner_, share_ = np.concatenate(rows), np.concatenate(owner), np.concatenate(share_of)[:, None]
            mean = np.zeros((len(batch), shape.dim))
            np.add.at(mean, owner_, embeddings[rows_] * share_)
            logits = mean @ softmax.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(2)[y[batch].astype(int)]) * weight[batch][:, None]
            back = error @ softmax
            unique, place = np.unique(rows_, return_inverse=True)
            grad = np.zeros((len(unique), shape.dim))
            np.add.at(grad, place, back[owner_] * share_)
            grad = (grad + shape.decay * embeddings[unique]) * held[unique][:, None]
            seen_e[unique] += (grad**2).mean(1)
            embeddings[unique] -= shape.rate * grad / np.sqrt(seen_e[unique])[:, None]
            grad_w = error.T @ mean / len(batch)
            seen_w += (grad_w**2).mean(1)
            softmax -= 0.1 * grad_w / np.sqrt(seen_w)[:, None]
            grad_b = error.mean(0)
            seen_b += grad_b**2
            bias -= 0.1 * grad_b / np.sqrt(seen_b)
        if epoch >= shape.epochs // 2:  # the mean of the later epochs' models depends less on the order of rows
            folded += embeddings @ (softmax[1] - softmax[0])
            shift += bias[1] - bias[0]
    taken = shape.epochs - shape.epochs // 2
    return ToxicityModel(folded / taken, shift / taken, shape)


def labelled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """(doc_id, toxic, text) of at most so many labelled rows of each class, those whose ids hash lowest; of several texts of an id the least."""
    ids = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 != 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [ids.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, most_toxic), (0, most_clean))]
    # both limits together bound what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 1_500, most_clean: int = 3_000, shape: Shape = Shape()) -> ToxicityModel:
    """A model from labelled documents, but for those held out: rows whose crc32 of the id as text leaves no rest by 5.

    ``most_toxic`` and ``most_clean`` bound the training rows, of whatever length; scoring has no bound.
    A document with several labels counts as toxic if one of them says so. Repeated rows count once; rows without an id
    or a label, labels without a document and all other columns are ignored; without rows of both classes see train_bags.

    Words and spans are cut out where the texts are, and one task trains on them; the driver gets the weights only.
    """
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, most_toxic, most_clean)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                words, spans = bag_of(batch.column(2)[at].as_py(), shape.span)
                columns = [*(batch.column(k).slice(at, 1) for k in range(2)), pa.array([words], pa.list_(pa.string())), pa.array([spans.ravel()], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "words", "spans"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[int] = []

        def bags() -> Iterator[Bag]:
            for batch in batches:
                toxic.extend(batch.column(0).to_pylist())
                for words, spans in zip(batch.column(1), batch.column(2)):
                    yield words.as_py(), np.array(spans.values, np.int32).reshape(-1, shape.span)

        model = train_bags(bags(), toxic, shape)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    bags = rows.mapInArrow(cut, f"doc_id {kind}, toxic int, words array<string>, spans array<int>").repartition(1).sortWithinPartitions("doc_id")
    found = bags.select("toxic", "words", "spans").mapInArrow(fitted, "weights binary, bias double").collect()
    return ToxicityModel(np.frombuffer(found[0].weights, np.float32), found[0].bias, shape) if found else train_bags([], [], shape)


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1, of the whole text; a null, empty or wordless text has the score of no words.

    One narrow pass in bounded batches; the weights travel as one broadcast of fixed size. Repeated rows repeat, an empty
    table stays empty, all columns of the input are kept; a clash with ``out`` raises ValueError, unused() finds a free name.
    """
    if unused(docs, out) != out:
        raise ValueError(f"docs has a column {out}")
    small_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.shape))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = ToxicityModel(*weights.value)
        for texts in batches:
            yield texts.map(held.score, na_action=None).astype("float64")

    return docs.withColumn(out, scored(F.col("text")))
