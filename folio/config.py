"""Tunables of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

CONF_PREFIX = "spark.folio."


@dataclass(frozen=True)
class EngineConfig:
    chunk_max_tokens: int = 400
    chunk_min_tokens: int = 40
    chunk_overlap_tokens: int = 40
    chunk_include_section_title: bool = True
    window_words: int = 180
    window_overlap: int = 30
    vector_top_k: int = 10
    bm25_top_k: int = 10
    hierarchy_top_k: int = 5
    rerank_top_k: int = 6
    similarity_threshold: float = 0.28
    max_refs_per_seed: int = 5
    max_context_tokens: int = 3000
    groundedness_retry_limit: int = 2
    min_sentence_overlap: float = 0.25
    lsa_dims: int = 128
    lsa_seed: int = 42
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    tfidf_max_df: float = 0.95
    #: Departures from the default behaviour, off unless asked for.
    drop_zero_vectors: bool = False
    attach_tables_to_nodes: bool = False

    @classmethod
    def from_session(cls, spark: SparkSession) -> EngineConfig:
        """Defaults, overlaid by session settings named ``spark.folio.<field>``."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(CONF_PREFIX + f.name, None)
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() == "true" if kind is bool else kind(text)
        return replace(cls(), **found)
