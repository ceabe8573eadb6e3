"""A stream of questions over a ready index, the pace of calls under one quota, section search by its index, and the command line."""

from __future__ import annotations

import io
import random

import pytest
from pyspark.sql import functions as F

from folio import cli
from folio.operators.generate import ModelProvider, Pace
from folio.operators.query import analyze_queries
from folio.operators.tree import index_tree, search_tree
from folio.plans import ingest
from folio.plans.answer import answer_queries
from folio.plans.ingest import build_index, build_search
from folio.sources import fixtures as fx
from folio.sources.scratch import BUCKET, of_keys
from folio.streaming import questions as streaming


@pytest.fixture(scope="module")
def index(spark):
    return build_index(fx.contract_lines(spark), fx.contract_tables(spark))


def test_stream_answers_as_a_batch_and_builds_nothing(spark, index, tmp_path, monkeypatch):
    search = build_search(index)
    asked = fx.contract_questions(spark).select("query_id", F.col("question").alias("text"))
    want = {r.query_id: r.answer for r in answer_queries(index, asked, search=search).collect()}
    for module in (ingest, streaming):
        monkeypatch.setattr(module, "build_search", lambda *a: pytest.fail("the index was built again"))
    got: dict[str, str] = {}
    batches = []

    def sink(answers, number):
        batches.append(number)
        got.update({r.query_id: r.answer for r in answers.collect()})

    def run():
        stream = streaming.read_question_stream(spark, str(tmp_path / "in"), per_trigger=1)
        streaming.answer_stream(stream, index, sink, str(tmp_path / "checkpoint"), search=search).awaitTermination()

    rows = asked.orderBy("query_id").collect()
    for k in range(2):
        spark.createDataFrame(rows[k::2]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run()
        assert got == {r.query_id: want[r.query_id] for r in [*rows[0::2], *(rows[1::2] if k else [])]}
    assert batches == [0, 1]


@pytest.mark.parametrize("tasks", [1, 3, 4])
def test_tasks_share_one_quota(tasks):
    """Calls of all tasks, each with a clock of its own run, stay a pause apart, and no slot is left while all are ready."""
    pause, rng, calls = 13.0, random.Random(tasks), []
    for task in range(tasks):
        now = [1_700_000_000 + rng.uniform(0, 40)]

        def sleep(seconds, now=now):
            now[0] += seconds

        pace = Pace(pause, tasks, task, clock=lambda now=now: now[0], sleep=sleep)
        for _ in range(30):
            pace.wait()
            calls.append(now[0])
            now[0] += rng.choice([0.0, 1.0, 30.0, 70.0])  # how long the reply takes
    calls.sort()
    assert all(b - a > pause - 1e-3 for a, b in zip(calls, calls[1:]))


def test_quick_replies_use_every_slot():
    made = []
    for task in range(3):
        now = [100.0]
        pace = Pace(10.0, 3, task, clock=lambda now=now: now[0], sleep=lambda s, now=now: now.__setitem__(0, now[0] + s))
        for _ in range(5):
            pace.wait()
            made.append(now[0])
    assert sorted(made) == [105.0 + 10 * k for k in range(15)]


def test_paced_provider_asks_every_row(spark):
    prompts = spark.range(9).select(F.col("id").cast("string").alias("system"), F.lit("u").alias("user"))
    got = ModelProvider("m", lambda: lambda s, u, n: (f"{s}!", 1, 1), tasks=3, pause=0.05).complete(prompts).collect()
    assert {r.answer for r in got} == {f"{k}!" for k in range(9)}


def test_section_index_finds_what_a_scan_finds(spark):
    rng = random.Random(3)
    words = ["rent", "lease", "boat", "ab", "x", "the", "renter", "oat", "se b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    rows = [(f"d{k % 7}", "root" if k < 7 else f"n{k}", k, None if k % 3 else str(k % 5), t if k % 4 else None, t) for k, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id string, node_no long, section_number string, title string, summary string")
    asked = [("q1", ["rent", "oat"], ["lease"], []), ("q2", ["x"], [], ["2"]), ("q3", ["zebra"], [], []), ("q4", [], ["ab", "se b"], []), ("q5", ["ab", "ab"], [], ["0"]), ("q6", ["boats"], [], [])]
    queries = spark.createDataFrame(asked, "query_id string, keywords array<string>, candidate_topics array<string>, explicit_section_refs array<string>")
    want = set()
    for q, kw, topics, refs in asked:
        for d in {r[0] for r in rows}:
            scored = []
            for doc, node, no, section, title, summary in rows:
                body = f"{title or ''} {summary or ''}".lower()
                score = 10.0 * (section in refs) + 3.0 * sum(t in body for t in topics) + sum(k in body for k in kw)
                if doc == d and node != "root" and score > 0:
                    scored.append((-score, no, node))
            want |= {(q, d, node, -s, rank) for rank, (s, _, node) in enumerate(sorted(scored)[:3], 1)}
    built = index_tree(nodes)
    for given in (nodes, built):
        assert {tuple(r) for r in search_tree(given, queries, 3).collect()} == want
    few = spark.createDataFrame([("ren",)], "gram string")
    read = of_keys(built.grams, "gram", few).select(F.input_file_name().alias("f")).distinct().count()
    assert BUCKET in built.grams.columns and 0 < read < built.grams.select(F.input_file_name().alias("f")).distinct().count()
    assert search_tree(built, queries.filter("false"), 3).count() == 0 and search_tree(nodes.filter("false"), queries, 3).count() == 0


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    fx.contract_lines(spark).write.parquet(str(tmp_path / "lines.parquet"))
    cli.main(["index", str(tmp_path / "lines.parquet"), "--name", "contract", "--out", str(tmp_path / "index")])
    assert "nodes" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("what is the monthly fee?\n\nexit\nnever asked\n"))
    cli.main(["ask", str(tmp_path / "index")])
    assert "Source" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["ask", str(tmp_path / "nowhere")])
    assert analyze_queries(spark.createDataFrame([("q", "fees?")], "query_id string, text string")).count() == 1
