"""The whole pipeline over the contract fixture."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.operators.context import build_context
from folio.operators.dense import search_grams
from folio.operators.generate import EXHAUSTED_ANSWER, SYSTEM_PROMPT, ExtractiveProvider, HttpModel, ModelProvider, wait_seconds
from folio.operators.lexical import index_terms, search_terms
from folio.operators.metrics import mean_metrics, retrieval_metrics
from folio.operators.rerank import FeatureReranker, ScorerReranker
from folio.operators.tree import search_tree
from folio.plans.answer import answer_queries
from folio.plans.evaluate import compare_baselines, evaluate_answers, rollup_rows
from folio.plans.ingest import Index, SearchIndex, build_index, build_search, build_windows
from folio.plans.retrieve import dense_hits, retrieve
from folio.sources import fixtures as fx
from folio.sources.questions import read_questions
from folio.sources.reports import CSV_COLUMNS, render_markdown, report_json, write_csv
from folio.sources.store import index_exists, load_index, load_search, save_index, save_search


@pytest.fixture(scope="module")
def index(spark):
    return build_index(fx.contract_lines(spark), fx.contract_tables(spark))


@pytest.fixture(scope="module")
def found(spark, index):
    asked = [("cause", "When can the lessor terminate for cause?"), ("named", "What does Section 4.2 say?"), ("fees", "What is the monthly fee of class A and B?"), ("both", "payment of invoices and notice")]
    return retrieve(index, spark.createDataFrame(asked, "query_id string, text string")).persist()


def best(found, query, n=5):
    return found.filter((F.col("query_id") == query) & (F.col("rank") <= n)).orderBy("rank").collect()


def test_tree_and_chunks(index):
    assert index.nodes.count() > 5
    assert index.chunks.filter("chunk_type = 'table'").count() == 2
    # a list of references that wraps over two lines is whole only in the chunk
    assert index.nodes.filter("section_number = '3'").first().referenced_sections == ["4", "5.1"]
    assert index.chunks.filter("section_number = '3'").first().referenced_sections == ["4", "5.1", "6"]
    # tables belong to no node's chunks, and text before the first heading to none
    assert index.nodes.filter("node_id = 'root'").first().raw_text == ""


def test_retrieval(found):
    assert {"4.2", "4.2.1"} & {r.section_number for r in best(found, "cause")}
    assert best(found, "named")[0].section_number == "4.2"
    assert any(r.chunk_id.endswith("-chunk") and "tbl" in r.chunk_id for r in best(found, "fees"))
    assert {"3.2", "6"} <= {r.section_number for r in best(found, "both", 8)}


def test_rerank_and_budget(found):
    top = FeatureReranker().rerank(found, 6)
    first = top.filter("query_id = 'cause' and rerank_no = 1").first()
    assert first.section_number in ("4.2", "4.2.1")
    wide, tight = build_context(top, 3000), build_context(top, 60)
    for w, t in zip(wide.orderBy("query_id").collect(), tight.orderBy("query_id").collect()):
        assert t.total_tokens <= 60 or len(t.blocks) == 1
        assert sorted(t.included_chunk_ids + t.dropped_for_budget) == sorted(w.included_chunk_ids)
        assert len({b.node_id for b in t.blocks}) == len(t.blocks)


def test_tables_can_be_attached(spark, index):
    asked = spark.createDataFrame([("q", "fees")], "query_id string, text string")
    plain, attached = (retrieve(index, asked, EngineConfig(attach_tables_to_nodes=on)) for on in (False, True))
    reached = lambda df: {r.chunk_id for r in df.filter(F.array_contains("provenance", "hierarchy")).collect()}
    assert {c for c in reached(attached) if "tbl" in c} and not {c for c in reached(plain) if "tbl" in c}


def test_scorer_reranker_seam(found):
    longest = ScorerReranker(lambda: lambda qs, ts: [float(len(t)) for t in ts]).rerank(found, 1)
    for r in longest.collect():
        assert len(r.source_text) == found.filter(F.col("query_id") == r.query_id).agg(F.max(F.length("source_text"))).first()[0]


class Flaky:
    """Ungrounded on the first attempt, then the extractor's answer."""

    name = "flaky"

    def __init__(self, always: bool = False) -> None:
        self.always = always

    def complete(self, prompts):
        good = ExtractiveProvider().complete(prompts)
        bad = F.lit(True) if self.always else ~F.contains("user", F.lit("Verification note"))
        return good.withColumn("answer", F.when(bad, "The lease costs $77,777 in total. [Source: Boat Lease, Section 99]").otherwise(F.col("answer")))


def test_answers(spark, index, found):
    queries = fx.contract_questions(spark).select("query_id", F.col("question").alias("text"))
    rows = {r.query_id: r for r in answer_queries(index, queries).collect()}
    assert rows["q5"].gated and rows["q5"].answer.startswith("INSUFFICIENT EVIDENCE") and rows["q5"].blocks
    assert rows["q6"].groundedness.passed and rows["q6"].citations and rows["q6"].retries_used == 0
    one = queries.filter("query_id = 'q6'")
    retried = answer_queries(index, one, provider=Flaky()).first()
    assert retried.retries_used == 1 and retried.groundedness.passed
    failed = answer_queries(index, one, provider=Flaky(always=True)).first()
    assert failed.retries_used == 2 and failed.answer == EXHAUSTED_ANSWER and not failed.groundedness.passed


def test_evaluation_and_reports(spark, index, tmp_path):
    questions = fx.contract_questions(spark)
    rows = evaluate_answers(index, questions).persist()
    for r in rows.collect():
        for c in ("context_precision", "context_recall", "answer_relevance", "faithfulness", "answer_correctness"):
            assert 0 <= r[c] <= 1
    rollup = rollup_rows(rows).persist()
    overall = rollup.filter("category is null").first()
    assert overall.n == 6 and overall.faithfulness == 1.0 and overall.wrongly_refused == 0
    base = compare_baselines(index, build_windows(fx.contract_lines(spark)), questions).persist()
    by = {r.baseline_id: r for r in base.collect()}
    assert [*sorted(by)] == [1, 2, 3, 4, 5] and all(r.n_questions == 5 and r.mean_ndcg <= 1 for r in by.values())
    assert by[2].mean_hit >= by[1].mean_hit and by[2].mean_tokens_retrieved < by[1].mean_tokens_retrieved and by[5].mean_mrr >= by[2].mean_mrr - 0.05
    assert '"n_questions":6' in report_json("Boat Lease", "x", base, rows, rollup).first().value
    write_csv(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text("utf-8-sig")
    assert text.splitlines()[0].split(",") == list(CSV_COLUMNS)
    assert "## q1 · simple_factual · answered" in render_markdown("Boat Lease", "x", rows, rollup)


def test_store_round_trip(spark, index, tmp_path):
    path = str(tmp_path / "index")
    assert not index_exists(spark, path)
    save_index(index, path)
    assert index_exists(spark, path)
    assert not [*(tmp_path / "index" / "chunks").glob("document_id=*")]  # no folder per document
    again = load_index(spark, path, fx.DOC)
    assert sorted(r.chunk_id for r in again.chunks.collect()) == sorted(r.chunk_id for r in index.chunks.collect())


def test_ids_that_look_like_numbers(spark, tmp_path):
    path, ids = str(tmp_path / "index"), ["007", "12345e67", "1", "1.0", "00000000"]
    rows = spark.createDataFrame([(i, f"{i}-1") for i in ids], "document_id string, chunk_id string")
    save_index(Index(rows, rows, rows), path)
    assert sorted(r.document_id for r in load_index(spark, path).chunks.collect()) == sorted(ids)
    for i in ids:
        assert [r.chunk_id for r in load_index(spark, path, i).chunks.collect()] == [f"{i}-1"]


def test_search_index_round_trip(spark, index, tmp_path):
    path = str(tmp_path / "index")
    queries = spark.createDataFrame([("q", "monthly fee of the lease"), ("none", "unheard")], "query_id string, text string")
    search = build_search(index)
    save_search(path, search)
    again = load_search(spark, path)
    assert sorted(search_terms(again.lexical, queries, 5).collect()) == sorted(search_terms(search.lexical, queries, 5).collect()) != []
    assert sorted(search_grams(again.grams, queries, 5).collect()) == sorted(search_grams(search.grams, queries, 5).collect()) != []
    assert sorted(dense_hits(index.chunks, queries, 5, model=again.lsa).collect()) == sorted(dense_hits(index.chunks, queries, 5, model=search.lsa).collect()) != []
    whole = SearchIndex(index_terms(index.chunks, per_document=False), search.grams, search.lsa)
    save_search(f"{path}-whole", whole)
    assert not load_search(spark, f"{path}-whole").lexical.per_document
    assert sorted(r.chunk_id for r in retrieve(index, queries, search=again).collect()) == sorted(r.chunk_id for r in retrieve(index, queries).collect())


def test_questions_of_one_document(spark, index, found):
    """A question that names a document is answered for that one; one without candidates still has its row."""
    asked = spark.createDataFrame([("cause", "When can the lessor terminate for cause?", fx.DOC), ("fees", "What is the monthly fee of class A and B?", "another"), ("named", "What does Section 4.2 say?", None)], "query_id string, text string, document_id string")
    rows = {(r.query_id, r.document_id): r for r in answer_queries(index, asked, candidates=found).collect()}
    assert {*rows} == {("cause", fx.DOC), ("fees", "another"), ("named", fx.DOC)}
    assert rows["fees", "another"].gated and rows["fees", "another"].n_candidates == 0 and rows["fees", "another"].answer.startswith("INSUFFICIENT EVIDENCE")


def test_tree_search_finds_what_a_scan_finds(spark, index):
    asked = [("a", ["lease", "fee", "zz"], ["payment"], ["4.2"]), ("b", ["e"], [], []), ("c", [], [], ["3"]), ("d", ["unheardof"], [], []), ("e", ["fee", "fee"], ["termination for cause"], [])]
    queries = spark.createDataFrame(asked, "query_id string, keywords array<string>, candidate_topics array<string>, explicit_section_refs array<string>")
    nodes = [r for r in index.nodes.collect() if r.node_id != "root"]
    want = set()
    for q, words, topics, refs in asked:
        score = {}
        for r in nodes:
            body = f"{r.title} {r.summary or ''}".lower()
            score[r.node_id] = 10.0 * (r.section_number in refs) + 3 * sum(t in body for t in topics) + sum(w in body for w in words)
        order = sorted((r for r in nodes if score[r.node_id] > 0), key=lambda r: (-score[r.node_id], r.node_no))
        want |= {(q, r.node_id, score[r.node_id], n) for n, r in enumerate(order[:4], 1)}
    assert {(r.query_id, r.node_id, r.score, r["rank"]) for r in search_tree(index.nodes, queries, 4).collect()} == want
    assert {(r.query_id, r.node_id, r.score, r["rank"]) for r in search_tree(index.nodes, queries.withColumn("document_id", F.lit(fx.DOC)), 4).collect()} == want


def test_fallback_per_question(spark, index):
    def failing():
        """A model that fails on its second call."""
        calls = []

        def call(system, user, most):
            calls.append(user)
            if len(calls) > 1:
                raise RuntimeError("quota")
            return "INSUFFICIENT EVIDENCE: the model says so.", 3, 4

        return call

    questions = fx.contract_questions(spark)
    rows = evaluate_answers(index, questions, provider=ModelProvider("live", failing, tasks=1)).collect()
    by = [(r.answer_source, r.used_mock_fallback, "the model says so" in r.answer) for r in rows]
    assert sum(live for *_, live in by) == 1 and all(not (fallback and live) for _, fallback, live in by) and sum(f for _, f, _ in by) >= 1
    prompts = spark.range(8).select(F.col("id").cast("string").alias("system"), F.lit("u").alias("user"))
    assert ModelProvider("live", failing, tasks=1, lenient=True).complete(prompts.repartition(4)).filter("answer is not null").count() == 1


def test_title_and_reference_terms_of_the_reranker(spark, found):
    """Title words add to a score, and chunks that only a reference leads to lose some."""
    rows = found.filter("query_id = 'fees'").limit(1).withColumns({"query_text": F.lit("monthly fee"), "source_text": F.lit("nothing"), "fused_score": F.lit(0.0)})
    score = lambda title, sources: FeatureReranker().rerank(rows.withColumns({"section_title": F.lit(title), "provenance": F.array(*map(F.lit, sources))}), 1).first()
    plain, titled, led = score("none", ["lexical"]), score("Monthly fee", ["lexical"]), score("none", ["cross_reference"])
    assert titled.rerank_score > plain.rerank_score > led.rerank_score and abs(plain.rerank_score - led.rerank_score - 0.15) < 1e-9
    assert titled.rationale == "title shares words" and led.rationale == "reached by reference"


def test_question_defaults(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"document_name": "d",\n "questions": [{"id": "1", "category": "c", "question": "q?"}]}')
    row = read_questions(spark, str(tmp_path / "q.json")).first()
    assert row.groups == [] and row.is_answerable and row.expected_answer == "" and row.notes == ""


def test_config_from_session(spark):
    spark.conf.set("spark.folio.rerank_top_k", "3")
    try:
        assert EngineConfig.from_session(spark).rerank_top_k == 3
    finally:
        spark.conf.unset("spark.folio.rerank_top_k")


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", k, t, 10) for k, t in enumerate(["no", "Has KEY", "key again", "x"], 1)], "query_id string, rank int, source_text string, token_count int")
    questions = spark.createDataFrame([("q", [["key"]]), ("none", [["zzz"]]), ("skipped", [])], "query_id string, groups array<array<string>>")
    got = {r.query_id: r for r in retrieval_metrics(ranked, questions, 3).collect()}
    assert {*got} == {"q", "none"} and got["q"].hit == 1 and got["q"].rr == 0.5 and abs(got["q"].precision - 2 / 3) < 1e-9 and got["none"].ndcg == 0
    assert abs(got["q"].ndcg - (1 / 1.5849625007 + 0.5) / (1 + 1 / 1.5849625007)) < 1e-6 and got["q"].tokens == 30
    assert mean_metrics(retrieval_metrics(ranked, questions, 3).withColumn("b", F.lit(1)), "b").first().n_questions == 2


def test_retry_waits():
    assert wait_seconds('{"error": {"details": [{"retryDelay": "7s"}]}}', 0, 65) == 8
    assert wait_seconds("not json", 3, 65) == 8 and wait_seconds("{}", 9, 65) == 65
    assert "data" in SYSTEM_PROMPT and HttpModel("l", "http://localhost:1", (), lambda *a: {}, lambda r: ("", 0, 0), retries=0)
    with pytest.raises(RuntimeError):
        HttpModel("l", "http://localhost:1", (), lambda *a: {}, lambda r: ("", 0, 0), retries=0)("s", "u", 1)


def test_runs_of_numbers_are_subtrees(spark):
    """A node's run of numbers holds what the closure holds, whatever depths headings have, and so do chunks found by it."""
    import random

    from folio.operators.tree import ROOT, build_nodes, chunks_below, closure, descendant_chunks, with_last

    rng = random.Random(5)
    blocks = [(f"d{d}", k, "heading" if rng.random() < 0.7 else "paragraph", f"t{k}", rng.randrange(1, 6)) for d in range(4) for k in range(40)]
    rows = [(d, k, kind, text, 1, 0.0, depth if kind == "heading" else 0, None, text if kind == "heading" else None, [], None) for d, k, kind, text, depth in blocks]
    df = spark.createDataFrame(rows, "document_id string, block_no long, block_type string, text string, page int, y0 double, depth int, section_number string, title string, referenced_sections array<string>, table_id string")
    nodes = build_nodes(df, df.select("document_id").distinct().withColumn("document_name", F.col("document_id"))).persist()
    below: dict[tuple, set] = {}
    for r in closure(nodes).collect():
        below.setdefault((r.document_id, r.ancestor_id), set()).add(r.node_id)
    numbers = {(r.document_id, r.node_id): (r.node_no, r.last_no) for r in with_last(nodes).collect()}
    for (d, a), want in below.items():
        low, high = numbers[d, a]
        assert want == {n for (e, n), (no, _) in numbers.items() if e == d and low <= no <= high} and (a != ROOT or low == 0)
    chunks = nodes.select("document_id", "node_id", F.concat("document_id", F.lit("-c-"), "node_id").alias("chunk_id"), F.col("node_no").alias("chunk_no"), F.when(F.col("node_no") % 7 == 3, "t").alias("table_id"))
    found = nodes.filter("node_no % 3 = 0 and document_id <> 'd3'").select("document_id", "node_id")
    for tables in (False, True):
        want = descendant_chunks(nodes, chunks, tables).join(found, ["document_id", "node_id"], "left_semi")
        assert sorted(chunks_below(found, nodes, chunks, tables).select(*want.columns).collect()) == sorted(want.collect())
    nodes.unpersist()
