"""Near copies: groups from the n-gram Jaccard join, one document kept of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import unused
from folio.llm.set_join import Jaccard, jaccard_components

#: Five-word shingles at a similarity of 0.8.
NEAR = Jaccard(percent=80, words=5)


def one_of_each_group(docs: DataFrame, j: Jaccard = NEAR) -> DataFrame:
    """``docs`` with the least doc_id of each group only, unchanged; a document without words or without an id stays.

    Repeated rows of a kept doc_id stay as they are; an empty table stays empty; no column of the input is touched. The ids to drop are few or many, so Spark picks the join: rows are
    dealt by doc_id, which no group can crowd.
    """
    gone = unused(docs, "gone")
    ids = jaccard_components(docs, j).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")
