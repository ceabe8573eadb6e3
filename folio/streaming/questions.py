"""A stream of questions against static indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folio.config import EngineConfig
from folio.plans.answer import answer_queries
from folio.plans.ingest import Index, SearchIndex, build_search
from folio.sources.scratch import stored


def read_question_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Questions from JSON files as they arrive in a folder."""
    return spark.readStream.schema("query_id string, text string").option("maxFilesPerTrigger", per_trigger).json(path)


def answer_stream(
    questions: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, config: EngineConfig = EngineConfig(), search: SearchIndex | None = None
) -> StreamingQuery:
    """Answers each micro-batch by the batch plan, since rankings per question are no streaming aggregation.

    ``sink`` gets the answers and the batch's number, by which a repeated batch can be told. ``search`` is the search index
    of ``index``; without it one is built here, once, and not for each batch.
    """
    built = search or build_search(index, config)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(answer_queries(index, stored(df, "questions"), config, search=built), number)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
