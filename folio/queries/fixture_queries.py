"""Queries over inline fixtures, for operators that the shared tables hold no input for; the SQL side gets the same rows as VALUES."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import cross_references, slug
from folio.operators.chunking import clauses, table_markdown
from folio.operators.context import build_context, context_blocks
from folio.operators.fusion import boost_explicit, expand_references, fuse, ranked
from folio.operators.generate import ExtractiveProvider
from folio.operators.ground import check_groundedness
from folio.operators.lines import assemble_lines, body_font_sizes, outside_tables, strip_running_lines
from folio.operators.metrics import rollup_rows
from folio.operators.query import analyze_queries
from folio.operators.structure import detect_structure, heading
from folio.operators.tree import ancestors, search_tree, with_breadcrumbs
from folio.plans.answer import answer_queries
from folio.plans.evaluate import compare_baselines, evaluate_answers
from folio.plans.ingest import Index, build_index, build_windows, documents_of
from folio.plans.retrieve import retrieve
from folio.queries.corpus import rerank_sql, rerank_topk
from folio.sources import fixtures as fx


def literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n"))
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]" if v else "[]::varchar[]"
    return f"{v}::double" if isinstance(v, float) else str(v)


def values(name: str, columns: str, rows: Sequence[Sequence[object]]) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def index(spark: SparkSession) -> Index:
    return build_index(fx.contract_lines(spark), fx.contract_tables(spark))


def questions(spark: SparkSession) -> DataFrame:
    return fx.contract_questions(spark).withColumn("text", F.col("question"))


def header_footer_strip(spark: SparkSession, _: str) -> DataFrame:
    lines = fx.contract_lines(spark)
    return strip_running_lines(lines, documents_of(lines)).select("line_no", "page", "text")


def line_assembly(spark: SparkSession, _: str) -> DataFrame:
    words = spark.createDataFrame([("w", p, t, x, x + 5, top, top + 8, s, f) for p, top, x, s, f, t in fx.WORD_BOXES], "document_id string, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    boxes = spark.createDataFrame([("w", *b) for b in fx.TABLE_BOXES], "document_id string, page int, bx0 double, btop double, bx1 double, bbottom double")
    return assemble_lines(outside_tables(words, boxes)).drop("document_id")


def heading_cases(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame(list(fx.HEADING_CASES), "text string, font_size double, is_bold boolean")
    h = heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.lit(10.0))
    return rows.select("text", h.isNotNull().alias("is_heading"), h["section_number"].alias("section_number"), h["title"].alias("title"), h["depth"].alias("depth"))


def cross_reference_cases(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in fx.REFERENCE_CASES], "text string").select("text", F.array_join(cross_references(F.col("text")), ",").alias("refs"))


def table_interleave(spark: SparkSession, _: str) -> DataFrame:
    lines = fx.contract_lines(spark)
    return detect_structure(lines, body_font_sizes(lines), fx.contract_tables(spark)).select("block_no", "block_type", "text")


def contract_tree(spark: SparkSession, _: str) -> DataFrame:
    return index(spark).nodes.select("node_id", "node_no", "title", "section_number", "depth", "parent_id", "page_start", "page_end", "summary", F.array_join("referenced_sections", ",").alias("refs"), F.array_join("table_ids", ",").alias("tables"))


def tree_ancestors(spark: SparkSession, _: str) -> DataFrame:
    return ancestors(index(spark).nodes).select("node_id", F.array_join("ancestor_ids", ",").alias("ancestors"))


def tree_breadcrumbs(spark: SparkSession, _: str) -> DataFrame:
    return with_breadcrumbs(index(spark).nodes).filter("node_id <> 'root'").select("node_id", "breadcrumb", "parent_section")


def clause_split(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame(list(fx.CLAUSE_CASES), "node string, text string")
    return rows.select("node", F.posexplode(clauses(F.col("text"))).alias("clause_no", "clause"))


def table_markdown_cases(spark: SparkSession, _: str) -> DataFrame:
    return fx.contract_tables(spark).select("table_id", table_markdown(F.col("headers"), F.col("rows")).alias("markdown"))


def contract_chunks(spark: SparkSession, _: str) -> DataFrame:
    return index(spark).chunks.select("chunk_id", "chunk_no", "chunk_type", "section_number", "page_start", "page_end", "token_count", "display_text", F.array_join("referenced_sections", ",").alias("refs"))


def hierarchy_search(spark: SparkSession, _: str) -> DataFrame:
    return search_tree(index(spark).nodes, analyze_queries(questions(spark)), 5).select("query_id", "node_id", "score", "rank")


def fusion_pool(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    hits = spark.createDataFrame(list(fx.FUSION_HITS), "query_id string, document_id string, source string, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame(list(fx.FUSION_CHUNKS), "document_id string, chunk_id string, chunk_no long, node_id string, section_number string, referenced_sections array<string>, table_id string")
    nodes = spark.createDataFrame(list(fx.FUSION_NODES), "document_id string, node_id string, node_no long, section_number string")
    asked = spark.createDataFrame(list(fx.FUSION_QUERIES), "query_id string, explicit_section_refs array<string>")
    return fuse(hits), chunks, nodes, asked


def shown(pool: DataFrame) -> DataFrame:
    return ranked(pool).select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"), F.array_join("provenance", ",").alias("provenance"), "rank")


def hybrid_fusion(spark: SparkSession, _: str) -> DataFrame:
    return shown(fusion_pool(spark)[0])


def explicit_boost(spark: SparkSession, _: str) -> DataFrame:
    pool, chunks, _nodes, asked = fusion_pool(spark)
    return shown(boost_explicit(pool, chunks, asked))


def crossref_expand(spark: SparkSession, _: str) -> DataFrame:
    pool, chunks, nodes, asked = fusion_pool(spark)
    return shown(expand_references(boost_explicit(pool, chunks, asked), chunks, nodes))


def context_rows(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        list(fx.CONTEXT_ROWS),
        "query_id string, document_id string, rerank_no int, chunk_id string, node_id string, section_number string, section_title string, parent_section string, page_start int, page_end int, rerank_score double, source_text string",
    )
    return rows.withColumn("document_name", F.lit("Doc"))


def context_block_cases(spark: SparkSession, _: str) -> DataFrame:
    return context_blocks(context_rows(spark)).select("query_id", "node_id", "order_no", "citation", "rendered", F.array_join("chunk_ids", ",").alias("chunk_ids"), "max_rerank_score")


def context_budget(spark: SparkSession, _: str) -> DataFrame:
    return build_context(context_rows(spark), 38).select("query_id", "total_tokens", "context_text", F.array_join("included_chunk_ids", ",").alias("included"), F.array_join("dropped_for_budget", ",").alias("dropped"))


BLOCK = "array<struct<document_name: string, section_number: string, section_title: string, text: string, citation: string>>"


def answer_context(spark: SparkSession) -> tuple[list, str]:
    return list(fx.ANSWER_BLOCKS), "\n".join(b[3] for b in fx.ANSWER_BLOCKS)


def groundedness(spark: SparkSession, _: str) -> DataFrame:
    blocks, text = answer_context(spark)
    rows = spark.createDataFrame([(c, a, blocks, text) for c, a in fx.ANSWER_CASES], f"case string, answer string, blocks {BLOCK}, context_text string")
    g = lambda k: F.array_join(f"groundedness.{k}", " | ").alias(k)
    return check_groundedness(rows).select("case", "groundedness.passed", "groundedness.is_insufficient_evidence", g("unsupported_sentences"), g("bad_citations"), g("unsupported_numbers"), F.size("groundedness.notes").alias("n_notes"))


def mock_answers(spark: SparkSession, _: str) -> DataFrame:
    blocks, _text = answer_context(spark)
    rows = spark.createDataFrame([(q, t, blocks, "") for q, t in fx.EXTRACT_QUESTIONS], f"query_id string, question string, blocks {BLOCK}, user string")
    return ExtractiveProvider().complete(rows).select("query_id", "answer")


def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_topk(spark, sf_dir).groupBy("query_id").agg(F.max("rerank_score").alias("top_rerank_score")).withColumn("gated", F.col("top_rerank_score") < 0.28)


def rag_rollup(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame(
        list(fx.ROLLUP_ROWS),
        "category string, context_precision double, context_recall double, answer_relevance double, faithfulness double, answer_correctness double, correctly_handled_answerability boolean, is_answerable boolean, answer_source string, groundedness_passed boolean",
    )
    out = rollup_rows(rows)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def slugs(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame([("Boat Lease (2024)",), ("--a  b--",), ("Äpfel & Co.",)], "name string").select("name", slug(F.col("name")).alias("slug"))


def contract_candidates(spark: SparkSession, _: str) -> DataFrame:
    return retrieve(index(spark), questions(spark)).select("query_id", "chunk_id", F.round("fused_score", 4).alias("fused_score"), F.array_join("provenance", ",").alias("provenance"), "rank")


def contract_answers(spark: SparkSession, _: str) -> DataFrame:
    return answer_queries(index(spark), questions(spark)).select("query_id", "answer", "retries_used", "gated", "total_tokens", F.col("groundedness.passed").alias("passed"))


def baseline_comparison(spark: SparkSession, _: str) -> DataFrame:
    means = compare_baselines(index(spark), build_windows(fx.contract_lines(spark)), fx.contract_questions(spark))
    return means.select("baseline_id", "name", *(F.round(c, 4).alias(c) for c in ("mean_precision", "mean_hit", "mean_mrr", "mean_ndcg", "mean_tokens_retrieved")), "n_questions")


def contract_evaluation(spark: SparkSession, _: str) -> DataFrame:
    rows = evaluate_answers(index(spark), fx.contract_questions(spark))
    return rows.select("question_id", "category", *(F.round(c, 4).alias(c) for c in ("context_precision", "context_recall", "answer_relevance", "faithfulness", "answer_correctness")), "answer_source", "retries_used")


ALL = (
    header_footer_strip, line_assembly, heading_cases, cross_reference_cases, table_interleave, contract_tree, tree_ancestors, tree_breadcrumbs, clause_split, table_markdown_cases, contract_chunks, hierarchy_search,
    hybrid_fusion, explicit_boost, crossref_expand, context_block_cases, context_budget, groundedness, mock_answers, gate_decisions, rag_rollup, slugs, contract_candidates, contract_answers, baseline_comparison, contract_evaluation,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracles() -> dict[str, str]:
    from folio.queries.fixture_sql import ORACLES

    return ORACLES | {"gate_decisions": f"select query_id, max(rerank_score) as top_rerank_score, max(rerank_score) < 0.28 as gated from ({rerank_sql()}) group by query_id"}
