"""Keeps a search index up to date with a folder of documents that grows.

    python -m jobs.ingest_documents --documents DIR --out DIR --checkpoint DIR [--config jobs/ingest_documents.json]

A file stream takes the Parquet files of DOCUMENTS that no run took before, cuts their texts into overlapping windows
with citations and counts the windows' terms. OUT gets three tables:

    documents/  lang=…/batch=…   one row for each text that was taken in, with its digest
    chunks/     lang=…/batch=…   windows with their citations
    postings/   batch=…          how often each term stands in each window, sorted by term

Document frequencies and lengths add up over batches, so a search over all batches gives what an index built at once
gives (``open_index``). A document that comes again unchanged is skipped; one that comes again with another text replaces
the earlier text, whose rows stay but are no longer read (``current_documents``).

The checkpoint tells which files were taken. A batch overwrites the partitions of its own number only, and the table of
documents, which the next batch is compared with, is written last: a run that was ended early, at whatever point, is made
good by the next one, with the same result.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions.text import citation
from folio.operators.chunking import as_chunks, text_windows
from folio.operators.lexical import LexicalIndex, count_terms, weigh_terms
from folio.sources.scratch import by_key, setting, stored
from jobs.command import command

LOG = logging.getLogger("ingest_documents")

#: What stands for a missing or empty language: undetermined.
UNDETERMINED = "und"
SCHEMAS = {
    "documents": "document_id string, digest string, n_chars long, lang string, batch long",
    "chunks": "document_id string, chunk_id string, chunk_no long, citation string, token_count int, source_text string, lang string, batch long",
    "postings": "document_id string, chunk_id string, chunk_no long, length int, term string, tf long, batch long",
}
PARTITIONS = {"documents": ("lang", "batch"), "chunks": ("lang", "batch"), "postings": ("batch",)}


@dataclass(frozen=True)
class Settings:
    """Columns of the input, files a batch at most, and the size of windows in words."""

    id_column: str = "doc_id"
    text_column: str = "text"
    lang_column: str = "lang"
    files_per_batch: int = 64
    window_words: int = 180
    window_overlap: int = 30

    def engine(self) -> EngineConfig:
        return EngineConfig(window_words=self.window_words, window_overlap=self.window_overlap)


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")


def replace_batch(df: DataFrame, out: str, name: str) -> None:
    """Writes one batch's rows: partitions that hold it are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(f"{out}/{name}")


def documents_of(rows: DataFrame, settings: Settings) -> DataFrame:
    """document_id, lang, text and digest, one row a document.

    A null text is empty; a document without an id has the digest of its text for one; of several texts with one id the
    one with the greatest digest is taken, whatever order they come in.
    """
    text = F.coalesce(F.col(settings.text_column), F.lit(""))
    named = rows.select(
        F.coalesce(F.col(settings.id_column).cast("string"), F.md5(text.cast("binary"))).alias("document_id"), F.coalesce(F.nullif(F.col(settings.lang_column), F.lit("")), F.lit(UNDETERMINED)).alias("lang"),
        text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    order = Window.partitionBy("document_id").orderBy(F.desc("digest"), "lang")
    return named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def last_of_each(documents: DataFrame) -> DataFrame:
    """document_id, batch and digest of the last batch that took each document in."""
    return documents.groupBy("document_id").agg(F.max_by(F.struct("batch", "digest"), "batch").alias("x")).select("document_id", "x.batch", "x.digest")


#: Bytes of text that one task of a batch is given, on average.
TASK_BYTES = 8 << 20


def tasks_for(spark: SparkSession, size: int) -> str:
    """How many tasks ``size`` bytes of text are dealt to, as a session's setting: as many as shuffles have, or more."""
    return str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES)))


def ingest_batch(rows: DataFrame, number: int, out: str, settings: Settings) -> dict[str, int]:
    """Takes in one batch. The same batch over the same earlier batches always writes the same rows.

    Texts and terms are dealt to more tasks the more text there is, so that a task's memory does not grow with the batch.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length(settings.text_column))).first()[0] or 0
    with setting(spark, "spark.sql.shuffle.partitions", tasks_for(spark, size)):
        return take_in(rows, number, out, settings)


def take_in(rows: DataFrame, number: int, out: str, settings: Settings) -> dict[str, int]:
    spark, batch = rows.sparkSession, F.lit(number).cast("long").alias("batch")
    before = last_of_each(read_table(spark, out, "documents").filter(F.col("batch") < number)).select(F.col("document_id").alias("known_id"), F.col("digest").alias("known"))
    texts = documents_of(rows, settings)
    new = texts.join(before, (F.col("document_id") == F.col("known_id")) & (F.col("digest") == F.col("known")), "left_anti")
    # a text is cut where it stands: its lines are not dealt out and gathered again
    windows = text_windows(new, "document_id", "text", settings.engine(), keep=("lang",))
    named = as_chunks(windows, keep=("lang",))
    cited = citation(F.col("document_name"), F.col("section_number"), F.col("page_start"), F.col("page_end")).alias("citation")
    replace_batch(named.select("document_id", "chunk_id", "chunk_no", cited, "token_count", "source_text", "lang", batch), out, "chunks")
    chunks = read_table(spark, out, "chunks").filter(F.col("batch") == number)
    postings, _ = count_terms(chunks)
    replace_batch(by_key(postings, "term", "chunk_id").withColumn("batch", batch), out, "postings")
    # last, since it is what the next batch is compared with
    replace_batch(new.select("document_id", "digest", F.length("text").cast("long").alias("n_chars"), "lang", batch), out, "documents")
    counts = {name: read_table(spark, out, name).filter(F.col("batch") == number).count() for name in SCHEMAS}
    return {"rows_read": rows.count(), **counts}


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Takes in what is new, in batches, and returns the sums of rows read and written."""
    for name, schema in SCHEMAS.items():
        # so that tables can be read before the first batch, and if it is empty
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*PARTITIONS[name]).parquet(f"{out}/{name}")
    done: dict[str, int] = {"batches": 0, "rows_read": 0, **dict.fromkeys(SCHEMAS, 0)}

    def batch(rows: DataFrame, number: int) -> None:
        counts = ingest_batch(rows, number, out, settings)
        LOG.info("batch %d: read %d rows of %s; wrote %s to %s", number, counts["rows_read"], documents, ", ".join(f"{counts[n]} {n}" for n in SCHEMAS), out)
        done["batches"] += 1
        for k, v in counts.items():
            done[k] += v

    table = spark.read.parquet(documents)
    parent, _, name = documents.rstrip("/").rpartition("/")
    # a stream takes folders and patterns, so one that is a file is named by a pattern of itself
    alone = [f.rpartition("/")[2] for f in table.inputFiles()] == [name]
    # files are known by their paths; none is too old to be new
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", settings.files_per_batch).option("maxFileAge", "36500d").parquet(f"{parent}/{{{name}}}" if alone else documents)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    LOG.info("read %d new rows of %s in %d batches; wrote %s to %s", done["rows_read"], documents, done["batches"], ", ".join(f"{done[n]} {n}" for n in SCHEMAS), out)
    return done


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of a table that belong to the last text of each document."""
    last = last_of_each(read_table(spark, out, "documents")).drop("digest")
    return read_table(spark, out, name).join(last, ["document_id", "batch"], "left_semi")


def current_documents(spark: SparkSession, out: str) -> DataFrame:
    return current(spark, out, "documents")


def open_index(spark: SparkSession, out: str, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, LexicalIndex]:
    """The windows of all documents as they are now and the index over them, for ``search_terms``."""
    chunks, postings = current(spark, out, "chunks"), current(spark, out, "postings").drop("batch")
    lengths = postings.groupBy("chunk_id").agg(F.max("length").alias("length"))
    sizes = chunks.select("chunk_id").join(lengths, "chunk_id", "left").select(F.coalesce("length", F.lit(0)).alias("length"))
    return chunks, LexicalIndex(postings, stored(by_key(weigh_terms(postings, sizes, config, per_document=False), "term"), "weights"), per_document=False)


if __name__ == "__main__":
    command(
        __doc__, "ingest_documents", Settings,
        {"documents": "folder of Parquet files, or one file", "out": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}, run,
    )
