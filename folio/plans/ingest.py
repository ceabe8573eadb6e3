"""From lines and tables to an index: tree, chunks, and what search needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.operators.chunking import chunk_documents, fixed_windows
from folio.operators.dense import GramIndex, Lsa, fit_lsa, index_grams
from folio.operators.lexical import LexicalIndex, index_terms
from folio.operators.lines import body_font_sizes, strip_running_lines
from folio.operators.structure import detect_structure
from folio.operators.tree import build_nodes, with_ranges_and_children, with_summaries
from folio.sources.scratch import stored, stored_by


@dataclass(frozen=True)
class Index:
    """Tables of one or many documents, keyed by document_id."""

    documents: DataFrame
    nodes: DataFrame
    chunks: DataFrame


@dataclass(frozen=True)
class SearchIndex:
    """What searches read: each document's terms, and the grams and vectors of all chunks."""

    lexical: LexicalIndex
    grams: GramIndex
    lsa: Lsa


def build_search(index: Index, config: EngineConfig = EngineConfig()) -> SearchIndex:
    grams = index_grams(index.chunks, config)
    return SearchIndex(index_terms(index.chunks, config), grams, fit_lsa(index.chunks, config, index=grams))


def documents_of(lines: DataFrame) -> DataFrame:
    return lines.groupBy("document_id").agg(F.first("document_name").alias("document_name"), F.max("page").alias("total_pages"))


def build_index(lines: DataFrame, tables: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> Index:
    """Strips running lines, finds structure, builds trees, cuts chunks, writes summaries: one plan for all documents."""
    documents, nodes = build_tree(lines, tables)
    documents = stored(documents, "documents")
    # chunks are read many times from here on
    return Index(documents, nodes, stored_by(chunk_documents(nodes, documents, tables, config), "chunks", "document_id"))


def build_tree(lines: DataFrame, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, and their nodes as a table in buckets by document: where lines and tables are in such buckets, too, nothing is shuffled."""
    documents = documents_of(lines)
    kept = strip_running_lines(lines, documents)
    blocks = detect_structure(kept, body_font_sizes(kept), tables)
    return documents, stored_by(with_summaries(with_ranges_and_children(build_nodes(blocks, documents))), "nodes", "document_id")


def build_windows(lines: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Fixed windows over the same lines, blind to structure."""
    return fixed_windows(strip_running_lines(lines, documents_of(lines)), config)
