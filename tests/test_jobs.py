"""The jobs on copies of tables: growing input, runs that are repeated or were ended early, and odd rows."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.operators.chunking import fixed_windows
from folio.operators.lexical import index_terms, search_terms
from folio.operators.lines import lines_of_texts
from folio.queries.job_queries import job1_ingest_documents
from jobs import answer_questions, ingest_documents
from jobs.command import settings_of

SCHEMA = "doc_id long, text string, lang string, batch string"
SMALL = ingest_documents.Settings(window_words=8, window_overlap=2, files_per_batch=1)


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def folders(tmp_path):
    return {"documents": str(tmp_path / "documents"), "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "checkpoint")}


def add(spark, folders, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folders["documents"])


def shown(spark, folders, name="chunks"):
    columns = {"chunks": ["document_id", "lang", "chunk_id", "citation", "token_count", "source_text"], "postings": ["chunk_id", "length", "term", "tf"], "documents": ["document_id", "lang", "n_chars"]}[name]
    return rows_of(ingest_documents.current(spark, folders["out"], name).select(*columns))


FIRST = [(1, "the lease ends in May and the rent is due on the first day of each month", "en", "x"), (2, "boats are kept at berth four", "en", "x"), (3, None, None, "x"), (None, "a text without an id", "", "x")]
SECOND = [(2, "boats are kept at berth nine from now on", "en", "y"), (4, "der Vertrag endet im Mai", "de", "y"), (1, FIRST[0][1], "en", "y")]


def test_second_run_takes_only_what_is_new(spark, folders):
    add(spark, folders, FIRST)
    first = ingest_documents.run(spark, settings=SMALL, **folders)
    assert first["rows_read"] == 4 and first["documents"] == 4 and first["batches"] == 1
    before = shown(spark, folders)
    files = {r.f for r in spark.read.parquet(f"{folders['out']}/chunks").select(F.input_file_name().alias("f")).distinct().collect()}
    add(spark, folders, SECOND)
    second = ingest_documents.run(spark, settings=SMALL, **folders)
    # document 1 came again unchanged
    assert second["rows_read"] == 3 and second["documents"] == 2 and second["batches"] == 1
    after = shown(spark, folders)
    assert {k for k in before if k[0] != "2"} <= {*after} and "boats are kept at berth four" not in {k[-1] for k in after} and "boats are kept at berth nine from now" in {k[-1] for k in after}
    assert files <= {r.f for r in spark.read.parquet(f"{folders['out']}/chunks").select(F.input_file_name().alias("f")).distinct().collect()}
    third = ingest_documents.run(spark, settings=SMALL, **folders)
    assert third["rows_read"] == third["batches"] == 0 and shown(spark, folders) == after


def test_same_as_one_run_over_everything(spark, folders, tmp_path):
    for part in (FIRST, SECOND):
        add(spark, folders, part)
        ingest_documents.run(spark, settings=SMALL, **folders)
    last = [r for r in FIRST if r[0] != 2] + SECOND[:2]
    whole = {k: str(tmp_path / f"whole-{k}") for k in folders}
    add(spark, whole, last)
    ingest_documents.run(spark, settings=SMALL, **whole)
    for name in ingest_documents.SCHEMAS:
        assert shown(spark, folders, name) == shown(spark, whole, name), name


def test_search_over_batches_is_search_over_an_index_built_at_once(spark, folders, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    settings = ingest_documents.Settings(files_per_batch=1)
    for k in range(3):
        docs.filter(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(folders["documents"])
        assert ingest_documents.run(spark, settings=settings, **folders)["batches"] == 1
    chunks, index = ingest_documents.open_index(spark, folders["out"])
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    whole = fixed_windows(lines_of_texts(docs))
    assert chunks.count() == whole.count()
    found, want = (rows_of(search_terms(x, asked, 5).select("query_id", "chunk_id", F.round("score", 6), "rank")) for x in (index, index_terms(whole, per_document=False)))
    assert found == want and len(want) > 20


@pytest.mark.parametrize("fails_at", ["chunks", "postings", "documents"])
def test_a_run_that_ended_early_is_made_good(spark, folders, monkeypatch, fails_at):
    add(spark, folders, FIRST)
    plain = ingest_documents.replace_batch

    def ending(df, out, name):
        if name == fails_at:
            raise RuntimeError("executor lost")
        plain(df, out, name)

    monkeypatch.setattr(ingest_documents, "replace_batch", ending)
    with pytest.raises(Exception, match="executor lost"):
        ingest_documents.run(spark, settings=SMALL, **folders)
    monkeypatch.setattr(ingest_documents, "replace_batch", plain)
    assert ingest_documents.run(spark, settings=SMALL, **folders)["documents"] == 4
    assert len(shown(spark, folders, "documents")) == 4 and all(n == 1 for n in shown(spark, folders).values())


def test_a_batch_done_twice_changes_nothing(spark, folders):
    add(spark, folders, FIRST)
    ingest_documents.run(spark, settings=SMALL, **folders)
    before = {name: shown(spark, folders, name) for name in ingest_documents.SCHEMAS}
    # as after a run that ended between the last write and the checkpoint's entry
    ingest_documents.ingest_batch(spark.read.parquet(folders["documents"]), 0, folders["out"], SMALL)
    assert {name: shown(spark, folders, name) for name in ingest_documents.SCHEMAS} == before


def test_odd_input(spark, folders):
    spark.createDataFrame([], SCHEMA).write.parquet(folders["documents"])
    assert ingest_documents.run(spark, settings=SMALL, **folders)["chunks"] == 0 and not shown(spark, folders)
    rows = [(7, "one text", "en", None), (7, "one text", "en", None), (8, "", "en", None), (9, "a", "fr", None), (9, "b", "de", None), (None, None, None, None), (10, "w " * 5_000, "en", None)]
    add(spark, folders, rows)
    done = ingest_documents.run(spark, settings=SMALL, **folders)
    assert done["documents"] == 5
    texts = {r.document_id: r.lang for r in ingest_documents.current_documents(spark, folders["out"]).collect()}
    assert texts["9"] in ("fr", "de") and len(texts) == 5 and {"7", "8", "9", "10"} < {*texts}
    per_document = Counter(k[0] for k in shown(spark, folders))
    assert per_document["7"] == 1 and per_document["8"] == 0 and per_document["9"] == 1 and per_document["10"] == 834


def test_a_single_file_is_streamed(spark, sf_dir, tmp_path):
    folders = {"documents": f"{sf_dir}/documents.parquet", "out": str(tmp_path / "o"), "checkpoint": str(tmp_path / "c")}
    first = ingest_documents.run(spark, **folders)
    assert first["rows_read"] == spark.read.parquet(folders["documents"]).count() and ingest_documents.run(spark, **folders)["rows_read"] == 0


def test_settings_are_restored_and_names_unique(spark, sf_dir):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    a, b = job1_ingest_documents(spark, sf_dir), job1_ingest_documents(spark, sf_dir)
    assert spark.conf.get(key) == before and not {*a.inputFiles()} & {*b.inputFiles()} and a.count() == b.count()


def questions(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("overwrite").parquet(path)


def test_answers_are_the_same_when_run_again(spark, sf_dir, tmp_path):
    paths = {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/conversations.parquet", "out": str(tmp_path / "out")}
    first = answer_questions.run(spark, **paths)
    rows = rows_of(answer_questions.read_answers(spark, paths["out"]))
    assert answer_questions.run(spark, **paths) == first and rows_of(answer_questions.read_answers(spark, paths["out"])) == rows
    asked = spark.read.parquet(paths["questions"]).filter("role = 'user'").select("conv_id").distinct().count()
    assert sum(rows.values()) == asked == first["questions"]
    summary = {r.outcome: r for r in spark.read.parquet(f"{paths['out']}/summary").collect()}
    assert {k: v.questions for k, v in summary.items()} == Counter(r[-1] for r in rows.elements())


def test_fewer_questions_leave_no_old_answers(spark, tmp_path):
    paths = {"documents": str(tmp_path / "d"), "questions": str(tmp_path / "q"), "out": str(tmp_path / "out")}
    spark.createDataFrame(
        [(1, "The lease of the boat ends in May. Rent is due each month.", "en", "x"), (2, "Berths are dredged in spring.", "en", "x"), (4, "Crews wash the decks on Sundays.", "en", "x"), (5, None, "en", "x"), (None, "No id at all.", "en", "x")], SCHEMA
    ).write.parquet(paths["documents"])
    turns = [(1, 0, "user", "x"), (1, 1, "assistant", "y"), (1, 2, "user", "when does the lease of the boat end"), (2, 0, "user", "zebra"), (3, 0, "user", None), (4, 0, "assistant", "z"), (5, 0, "user", "")]
    questions(spark, paths["questions"], turns)
    got = answer_questions.run(spark, **paths)
    rows = {r.query_id: r for r in answer_questions.read_answers(spark, paths["out"]).collect()}
    assert {*rows} == {"1", "2", "5"} and rows["1"].answer == "The lease of the boat ends in May. [Source: document 1, Section 1]" and rows["1"].grounded and got["questions"] == 3
    assert rows["2"].outcome == rows["5"].outcome == "gate_refusal" and rows["2"].n_candidates == 0
    questions(spark, paths["questions"], turns[:3])
    answer_questions.run(spark, **paths)
    assert [r.query_id for r in answer_questions.read_answers(spark, paths["out"]).collect()] == ["1"]
    questions(spark, paths["questions"], [])
    assert answer_questions.run(spark, **paths)["questions"] == 0 and answer_questions.read_answers(spark, paths["out"]).count() == 0


def test_settings_file(tmp_path):
    assert settings_of(ingest_documents.Settings, "jobs/ingest_documents.json") == ingest_documents.Settings()
    assert settings_of(answer_questions.Settings, "jobs/answer_questions.json") == answer_questions.Settings()
    (tmp_path / "c.json").write_text(json.dumps({"windowwords": 3}))
    with pytest.raises(ValueError, match="windowwords"):
        settings_of(ingest_documents.Settings, str(tmp_path / "c.json"))


def test_command_line(spark, folders, monkeypatch):
    add(spark, folders, FIRST)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    from jobs.command import command

    argv = [x for k, v in folders.items() for x in (f"--{k}", v)] + ["--config", "jobs/ingest_documents.json"]
    done = command(ingest_documents.__doc__, "t", ingest_documents.Settings, dict.fromkeys(folders, ""), ingest_documents.run, argv)
    assert done["documents"] == 4


def test_more_text_is_dealt_to_more_tasks(spark, folders, monkeypatch):
    seen = []
    inner = ingest_documents.take_in
    monkeypatch.setattr(ingest_documents, "take_in", lambda rows, *a: (seen.append(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), inner(rows, *a))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    add(spark, folders, FIRST)
    ingest_documents.run(spark, settings=SMALL, **folders)
    monkeypatch.setattr(ingest_documents, "TASK_BYTES", 10)
    add(spark, folders, [(9, "berth " * 20, "en", "z")])
    ingest_documents.run(spark, settings=SMALL, **folders)
    assert seen == [int(before), 12] and spark.conf.get("spark.sql.shuffle.partitions") == before
