"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import code_documents
from folio.llm.common import scratch, table, unused, written
from folio.llm.decontaminate import decontaminated
from folio.llm.near_copies import one_of_each_group
from folio.llm.quality_model import fit_quality, score_quality
from folio.llm.queries import vocabulary_path
from folio.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity, whole rows unchanged, whatever their columns are called.

    A null, empty or wordless text has the score of no words; repeated rows are judged alike; an empty table stays empty.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity_score")
    return score_toxicity(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for quality, whole rows unchanged, whatever their columns are called.

    A null or empty text has the score of features that are zero; repeated rows are judged alike; an empty table stays empty.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "quality_score")
    return score_quality(docs, model, score).filter(F.col(score) >= 0.7).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id; rows stay whole.

    A text without words and a row without an id stay; repeated rows of a kept id stay as they are; an empty table stays empty.
    """
    return one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, rows whole and unchanged.

    A null or empty text holds none and stays; repeated rows are judged alike; an empty table stays empty, and an empty
    benchmark drops nothing.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the text that they decode to, and the token ids of each row.

    A null or empty text has none; repeated rows repeat; an empty table stays empty; other columns are left behind.
    """
    return code_documents(docs, vocabulary_path(), keep=("ids",))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: Trained models decide what stays, so SQL cannot express the result; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
