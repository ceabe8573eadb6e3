"""Saved indexes: Parquet tables of documents, nodes and chunks, in the order of document ids, and of what searches read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.operators.dense import GramIndex, Lsa, LsaTables
from folio.operators.lexical import LexicalIndex
from folio.plans.ingest import Index, SearchIndex
from folio.sources.scratch import BUCKET, by_key, in_buckets

TABLES = ("documents", "nodes", "chunks")
#: In the order of terms and grams.
LEXICAL, GRAMS, VECTORS = ("postings", "weights"), ("grams", "vocabulary", "norms"), ("inverted", "chunk_vectors")
FACTORS = "at int, factor binary, dims int"


def save_index(index: Index, path: str, mode: str = "overwrite") -> None:
    """Rows sorted by document over few files: no folder per document, and one document's part is found by row groups' bounds."""
    for name in TABLES:
        by_key(getattr(index, name), "document_id").write.mode(mode).parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, document_id: str | None = None) -> Index:
    """The whole index, or one document's part, for which only row groups that may hold it are read."""
    def one(name: str):
        # ids are text in the files themselves, so those that look like numbers stay as they are
        df = spark.read.parquet(f"{path}/{name}")
        return df.filter(F.col("document_id") == document_id) if document_id is not None else df
    return Index(*map(one, TABLES))


def save_search(path: str, search: SearchIndex, mode: str = "overwrite") -> None:
    """The search index beside a saved index, as built: postings, weights, grams, norms, vocabulary, vectors and the projection."""
    spark = search.grams.grams.sparkSession
    scope = "document" if search.lexical.per_document else "corpus"
    in_buckets(search.lexical.postings.drop(BUCKET), "term", "chunk_id").write.mode(mode).partitionBy(BUCKET).parquet(f"{path}/lexical-{scope}/postings")
    search.lexical.weights.write.mode(mode).parquet(f"{path}/lexical-{scope}/weights")
    in_buckets(search.grams.grams.drop(BUCKET), "gram", "chunk_id").write.mode(mode).partitionBy(BUCKET).parquet(f"{path}/grams/grams")
    for name in GRAMS[1:]:
        getattr(search.grams, name).write.mode(mode).parquet(f"{path}/grams/{name}")
    for name in VECTORS:
        getattr(search.lsa, name).write.mode(mode).parquet(f"{path}/vectors/{name}")
    if isinstance(search.lsa, LsaTables):
        search.lsa.factors.select("*", F.lit(search.lsa.dims).alias("dims"), F.lit(search.lsa.rows).alias("rows")).write.mode(mode).parquet(f"{path}/vectors/factor_tables")
        return
    rows = [(k, bytearray(v.tobytes()), search.lsa.dims) for k, v in enumerate(search.lsa.factors.value)]
    spark.createDataFrame(rows, FACTORS).write.mode(mode).parquet(f"{path}/vectors/factors")


def load_search(spark: SparkSession, path: str) -> SearchIndex:
    """The search index as saved; the factors of a fit that the driver held, some hundred numbers a chunk, go to every executor as after it."""
    per_document = exists(spark, f"{path}/lexical-document")
    folder = f"{path}/lexical-{'document' if per_document else 'corpus'}"
    lexical = LexicalIndex(*(spark.read.parquet(f"{folder}/{name}") for name in LEXICAL), per_document)
    grams = GramIndex(*(spark.read.parquet(f"{path}/grams/{name}") for name in GRAMS))
    inverted, vectors = (spark.read.parquet(f"{path}/vectors/{name}") for name in VECTORS)
    if exists(spark, f"{path}/vectors/factor_tables"):
        factors = spark.read.parquet(f"{path}/vectors/factor_tables")
        sizes = factors.first()
        return SearchIndex(lexical, grams, LsaTables(inverted, factors.drop("dims", "rows"), vectors, sizes.dims, sizes["rows"]))
    rows = spark.read.schema(FACTORS).parquet(f"{path}/vectors/factors").orderBy("at").collect()
    dims = rows[0].dims if rows else 2
    factors = np.frombuffer(b"".join(bytes(r.factor) for r in rows), np.float32).reshape(-1, dims)
    return SearchIndex(lexical, grams, Lsa(inverted, spark.sparkContext.broadcast(factors), vectors, dims))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether a tree was saved at ``path``, on whatever file system that is."""
    return exists(spark, f"{path}/nodes")
