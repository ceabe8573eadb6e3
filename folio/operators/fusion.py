"""Score fusion of vector, lexical and section hits, with cross-reference expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions.text import min_max
from folio.operators.tree import chunks_below, first_by_section, search_tree
from folio.sources.scratch import stored

KEYS = ["query_id", "document_id"]
#: In the order in which their hits enter the pool.
SOURCES = ("vector", "lexical", "hierarchy")
CROSS_REFERENCE = "cross_reference"
EXPLICIT = "explicit_reference"
EXPLICIT_BOOST = 5.0
REFERENCE_SCORE = 0.3
AGREEMENT = 0.15


def hierarchy_hits(nodes: DataFrame, chunks: DataFrame, analysed: DataFrame, top_k: int, with_tables: bool = False) -> DataFrame:
    """(query_id, document_id, chunk_id, score, rank) of the chunks under the best sections; of several scores the largest."""
    found = chunks_below(stored(search_tree(nodes, analysed, top_k), "sections"), nodes, chunks, with_tables)
    merged = found.groupBy(*KEYS, "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("rank", "path")).alias("seen"))
    return merged.select(*KEYS, "chunk_id", "score", F.row_number().over(Window.partitionBy(*KEYS).orderBy("seen")).alias("rank"))


def fuse(hits: DataFrame) -> DataFrame:
    """Pool of candidates from ``hits`` (query_id, document_id, chunk_id, source, score, rank).

    Each source's scores are scaled to 0..1 per query; a source with one value gives 1. A candidate gets the mean of its
    scores and a bonus for each source beyond the first. One long table is grouped, where three outer joins would be.
    """
    own = Window.partitionBy(*KEYS, "source")
    scaled = hits.withColumn("s", min_max(F.col("score"), F.min("score").over(own), F.max("score").over(own)))
    order = F.coalesce(*(F.when(F.col("source") == s, k) for k, s in enumerate(SOURCES)))
    pool = scaled.withColumn("o", order).groupBy(*KEYS, "chunk_id").agg(
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("o", "source", "s"))), lambda x: F.struct(x["source"], x["s"]))).alias("scores"),
        F.sort_array(F.collect_list(F.struct("o", "source")))["source"].alias("provenance"),
        (F.avg("s") * (1 + AGREEMENT * (F.count(F.lit(1)) - 1))).alias("fused_score"),
        F.min(F.struct("o", "rank")).alias("seen"),
    )
    return pool.withColumn("pool_no", F.row_number().over(Window.partitionBy(*KEYS).orderBy("seen"))).drop("seen")


def boost_explicit(pool: DataFrame, chunks: DataFrame, analysed: DataFrame) -> DataFrame:
    """Adds to the score of pool members whose section the query names."""
    told = pool.join(chunks.select("document_id", "chunk_id", "section_number"), ["document_id", "chunk_id"]).join(analysed.select("query_id", "explicit_section_refs"), "query_id")
    named = F.coalesce(F.array_contains("explicit_section_refs", F.col("section_number")), F.lit(False))
    return told.withColumns({
        "fused_score": F.col("fused_score") + F.when(named, EXPLICIT_BOOST).otherwise(0.0),
        "provenance": F.when(named, F.concat("provenance", F.array(F.lit(EXPLICIT)))).otherwise(F.col("provenance")),
    }).drop("section_number", "explicit_section_refs")


def expand_references(pool: DataFrame, chunks: DataFrame, nodes: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Pool with the chunks of sections that its members refer to, one hop.

    Only the first few references of a member count, and only the first section with a number, with its own text
    chunks. Members that are referred to are marked; others enter behind the pool with a small fixed score.
    """
    seeds = pool.select(*KEYS, "chunk_id", "pool_no").join(chunks.select("document_id", "chunk_id", "referenced_sections"), ["document_id", "chunk_id"])
    refs = seeds.select(*KEYS, "pool_no", F.posexplode(F.slice("referenced_sections", 1, config.max_refs_per_seed)).alias("ref_no", "section_number"))
    own = (chunks if config.attach_tables_to_nodes else chunks.filter("table_id is null")).select("document_id", "node_id", F.col("chunk_id").alias("target"), F.col("chunk_no").alias("target_no"))
    reached = refs.join(first_by_section(nodes), ["document_id", "section_number"]).join(own, ["document_id", "node_id"])
    targets = reached.groupBy(*KEYS, F.col("target").alias("chunk_id")).agg(F.min(F.struct("pool_no", "ref_no", "target_no")).alias("seen"))
    marked = pool.join(targets.select(*KEYS, "chunk_id", F.lit(True).alias("_hit")), [*KEYS, "chunk_id"], "left")
    kept = marked.withColumn("provenance", F.when(F.col("_hit"), F.concat("provenance", F.array(F.lit(CROSS_REFERENCE)))).otherwise(F.col("provenance"))).drop("_hit")
    fresh = targets.join(pool.select(*KEYS, "chunk_id"), [*KEYS, "chunk_id"], "left_anti")
    behind = F.row_number().over(Window.partitionBy(*KEYS).orderBy("seen")) + 1_000_000
    new = fresh.select(
        *KEYS, "chunk_id", F.create_map(F.lit(CROSS_REFERENCE), F.lit(REFERENCE_SCORE)).alias("scores"), F.array(F.lit(CROSS_REFERENCE)).alias("provenance"),
        F.lit(REFERENCE_SCORE).alias("fused_score"), behind.alias("pool_no"),
    )
    return kept.unionByName(new)


def ranked(pool: DataFrame) -> DataFrame:
    """Adds ``rank``: by score, ties in the order of the pool."""
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(F.round("fused_score", 9)), "pool_no")))


def hybrid_candidates(
    analysed: DataFrame, nodes: DataFrame, chunks: DataFrame, vector_hits: DataFrame, lexical_hits: DataFrame,
    config: EngineConfig = EngineConfig(), use_hierarchy: bool = True, use_cross_reference: bool = True,
) -> DataFrame:
    """Ranked candidates of every analysed query in every document: query_id, document_id, chunk_id, scores, provenance, fused_score, pool_no, rank."""
    columns = [*KEYS, "chunk_id", "score", "rank"]
    hits = vector_hits.select(*columns, F.lit(SOURCES[0]).alias("source")).unionByName(lexical_hits.select(*columns, F.lit(SOURCES[1]).alias("source")))
    if use_hierarchy:
        hits = hits.unionByName(hierarchy_hits(nodes, chunks, analysed, config.hierarchy_top_k, config.attach_tables_to_nodes).select(*columns, F.lit(SOURCES[2]).alias("source")))
    pool = boost_explicit(fuse(hits), chunks, analysed)
    if use_cross_reference:
        pool = expand_references(pool, chunks, nodes, config)
    return ranked(pool)
