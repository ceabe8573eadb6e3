"""Question sets from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question: query_id, category, question, groups, is_answerable, expected_answer, notes, document_name, question_no; missing keys get their defaults."""
    sets = spark.read.schema(schemas.QUESTIONS).json(path, multiLine=True)
    rows = sets.select("document_name", F.posexplode("questions").alias("question_no", "q"))
    none = F.array().cast("array<array<string>>")
    return rows.select(
        F.col("q.id").alias("query_id"), "q.category", "q.question", F.coalesce("q.expected_keyword_groups", none).alias("groups"), F.coalesce("q.is_answerable", F.lit(True)).alias("is_answerable"),
        F.coalesce("q.expected_answer", F.lit("")).alias("expected_answer"), F.coalesce("q.notes", F.lit("")).alias("notes"), "document_name", "question_no",
    )
