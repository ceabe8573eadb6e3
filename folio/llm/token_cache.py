"""Token counts from a digest cache: known contents are looked up, each unknown one is encoded once and remembered.

A content is known by the SHA-256 of its normal form, a tokenizer by a digest of its file, its library and how it is
called. The cache is a Parquet table of both digests and the count, with a folder for each tokenizer, to which a run
only appends. Digests move, texts stay where they are read; only when very many contents are unknown do texts move, once,
to the keys of those to encode.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib.metadata import version

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import removed, scratch, small_batches, unused, written

#: The cache: tokenizer digest (a folder each), content digest, number of tokens.
CACHE_COLUMNS = ("content", "n_tokens", "tokenizer")
CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"
#: Parts that the rows of one content are dealt to when counts go back to rows.
SALTS = 64
#: Misses up to which their keys go to every task, a megabyte or so; beyond, they meet the texts in a shuffle.
MOST_SENT = 10_000
#: Counts that a task remembers.
MOST_RECENT = 10_000


def as_it_is(text: Column) -> Column:
    """The normal form that changes no count of any tokenizer: a null text is empty."""
    return F.coalesce(text, F.lit(""))


@dataclass(frozen=True)
class TokenCounter:
    """A tokenizer file and the library for it: ``tokenizers`` for .json, ``sentencepiece`` for .model.

    ``normal`` maps a text to the form that is digested and encoded. It may join texts only where the tokenizer gives
    them equal counts, such as lower case for a tokenizer that lowers case itself.
    """

    path: str
    normal: Callable[[Column], Column] = as_it_is

    @property
    def library(self) -> str:
        if self.path.endswith(".json"):
            return "tokenizers"
        if self.path.endswith(".model"):
            return "sentencepiece"
        raise ValueError(f"no library for {self.path}: the file must end in .json or .model")

    def digest(self) -> str:
        """Changes with the file, the library's version and how texts are encoded, so stale counts are never met."""
        with open(self.path, "rb") as f:
            file = hashlib.sha256(f.read()).hexdigest()
        return hashlib.sha256(f"{file} {self.library} {version(self.library)} plain".encode()).hexdigest()


@lru_cache(maxsize=2)
def counting(path: str, library: str) -> Callable[[str], int]:
    """Number of tokens of a text without begin, end or added special tokens; one tokenizer a Python worker."""
    if library == "tokenizers":
        # a task has one core; the library's own threads would take the others'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.no_truncation()
        coder.no_padding()
        return lambda text: len(coder.encode_batch_fast([text], add_special_tokens=False)[0])
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


def counted(path: str, library: str):
    """A function over Arrow batches: content digest and text in, digest and count out, one text at a time.

    A content that came a short while ago in the same task, as rows that share id and text do, is not encoded again.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, recent = counting(path, library), {}
        for batch in batches:
            counts = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest not in recent:
                    if len(recent) >= MOST_RECENT:
                        recent.clear()
                    recent[digest] = count(text.as_py())
                counts.append(recent[digest])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """content and n_tokens of what is cached for a tokenizer; one row each, though two runs at once stored it twice."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def open_cache(spark: SparkSession, path: str) -> None:
    """Makes an empty cache at ``path`` if there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)


def keys_of(docs: DataFrame, counter: TokenCounter, text_col: str) -> DataFrame:
    """``docs`` without its text, with ``_content``, ``_bytes`` and ``_salt``: all that later steps need of a row."""
    normal = counter.normal(F.col(text_col))
    # the salt parts rows of one content; it only has to stay as it is once these rows are stored
    return docs.select(
        *[c for c in docs.columns if c != text_col],
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("_content"),
        F.octet_length(as_it_is(F.col(text_col))).cast("long").alias("_bytes"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"),
    )


def missing(keys: DataFrame, cache: DataFrame, id_col: str) -> DataFrame:
    """One row for each content that the cache lacks: its digest and the least id of a row that holds it.

    Counted per salt first, so that a content of very many rows is gathered from 64 rows at most.
    """
    parts = keys.groupBy("_content", "_salt").agg(F.min(id_col).alias("_first"))
    firsts = parts.groupBy("_content").agg(F.min("_first").alias("_first"))
    return firsts.join(cache, F.col("_content") == F.col("content"), "left_anti")


def encoded(docs: DataFrame, misses: DataFrame, n_misses: int, counter: TokenCounter, id_col: str, text_col: str) -> DataFrame:
    """Counts of the missing contents, each from the row that stands for it."""
    texts = docs.select(F.col(id_col).alias("_id"), counter.normal(F.col(text_col)).alias("_text"))
    texts = texts.withColumn("_digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    # few misses go to every task and no text moves; many meet the texts by row, so copies of a text go to different tasks.
    # Either way the side of the keys is hashed, so that texts are never sorted
    side = F.broadcast(misses) if n_misses <= MOST_SENT else misses.hint("shuffle_hash")
    chosen = texts.join(side, (F.col("_digest") == F.col("_content")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
    small_batches(docs.sparkSession)
    return chosen.select("_digest", "_text").mapInArrow(counted(counter.path, counter.library), "content binary, n_tokens long")


def count_tokens(docs: DataFrame, counter: TokenCounter, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text; misses are added to the cache.

    A null text counts as empty, with 0 bytes. Repeated rows repeat. Rows of one content are encoded once; those that share
    both id and text, once a task. Null ids are kept. An empty table stays empty and adds nothing. Input columns stay as they are, unless they have the names of the two results, which
    then get underscores before them. A very long text is one task's work, alone in memory. A run that ends early has
    added all of its misses or none; running it again is safe.
    """
    spark, tokenizer = docs.sparkSession, counter.digest()
    n_bytes, n_tokens = unused(docs, "n_bytes"), unused(docs, "n_tokens")
    kept = [c for c in docs.columns if c != text_col]
    # own names for the input's columns, so that none can clash with those of this module
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)])
    named = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    own_id, own_text = named[id_col], named[text_col]
    open_cache(spark, cache_path)
    folder = scratch(spark, "token_counts")
    keys = written(keys_of(own, counter, own_text), f"{folder}/keys")
    misses = written(missing(keys, read_cache(spark, cache_path, tokenizer), own_id), f"{folder}/misses")
    n_misses = misses.count()
    if n_misses:
        new = encoded(own, misses, n_misses, counter, own_id, own_text).select("content", "n_tokens", F.lit(tokenizer).alias("tokenizer"))
        # a row that is repeated whole was chosen with its repeats
        new.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).select(*CACHE_COLUMNS).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    removed(spark, f"{folder}/misses")
    # counts reach the salted groups first (64 rows of a content at most), then the rows, by content and salt
    groups = keys.select("_content", "_salt").distinct()
    known = groups.join(read_cache(spark, cache_path, tokenizer), F.col("_content") == F.col("content")).select("_content", "_salt", "n_tokens")
    out = keys.join(known, ["_content", "_salt"], "left")
    return out.select(*[F.col(named[c]).alias(c) for c in kept], F.col("_bytes").alias(n_bytes), F.col("n_tokens").alias(n_tokens))
