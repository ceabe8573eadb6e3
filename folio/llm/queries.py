"""The registered queries of this package: op1 to op12, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import code_documents
from folio.llm.common import scratch, table, written
from folio.llm.decontaminate import find_contamination
from folio.llm.hard_negatives import integer_vectors, mine_negatives
from folio.llm.html_extract import extract_pages
from folio.llm.license_scan import known_digests, scan_licenses
from folio.llm.quality_model import fit_quality, score_quality
from folio.llm.quality_rules import document_statistics, judge_quality
from folio.llm.set_join import jaccard_components
from folio.llm.token_cache import TokenCounter, count_tokens
from folio.llm.toxicity import fit_toxicity, score_toxicity
from folio.llm.url_filter import url_verdicts
from folio.llm.warc import read_records, reassembled, write_archives


def vocabulary_path() -> str:
    """The public vocabulary that op1 uses; its package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    # so small that many pages are cut into segments and put together again
    write_archives(table(spark, sf_dir, "pages"), path, segment_bytes=8_192)
    return reassembled(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(document_statistics(table(spark, sf_dir, "documents")), scratch(spark, "statistics"))
    judged = judge_quality(stats, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.col("matches.edits").alias("edits"), F.col("matches.end").alias("ends")
    )


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = written(integer_vectors(rows.withColumn("label", label)), scratch(spark, "vectors"))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = count_tokens(docs, TokenCounter(vocabulary_path()), scratch(spark, "token_cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_warc, op3_quality_model, op4_quality_rules, op5_toxicity, op6_decontaminate, op7_set_join, op8_url_filter, op9_html_text, op10_license_scan, op11_hard_negatives, op12_token_counts)}
