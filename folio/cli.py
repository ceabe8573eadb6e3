"""Command line: index documents, ask, evaluate.

python -m folio.cli index SOURCE [--name NAME] [--out DIR]
python -m folio.cli ask INDEX_DIR [--verbose]
python -m folio.cli evaluate SOURCE QUESTIONS [--top-k 5] [--out BASE] [--skip-generation]

SOURCE is a PDF (with pdfplumber), or a JSON-lines or Parquet file of lines with the declared schema.
"""

from __future__ import annotations

import argparse
import datetime
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas
from folio.config import EngineConfig
from folio.operators.generate import describe_provider, get_provider
from folio.operators.lines import assemble_lines, numbered_lines, outside_tables
from folio.plans.answer import answer_queries
from folio.plans.evaluate import compare_baselines, evaluate_answers, rollup_rows
from folio.plans.ingest import build_index, build_search, build_windows
from folio.sources.pdf import read_pdfs
from folio.sources.questions import read_questions
from folio.sources.reports import print_tables, render_markdown, report_json, write_csv, write_json
from folio.sources.store import index_exists, load_index, load_search, save_index, save_search


def slug(name: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in name.lower()).strip("-")


def read_lines(spark: SparkSession, source: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    if source.lower().endswith(".pdf"):
        words, tables, boxes = read_pdfs(spark, source)
        return numbered_lines(assemble_lines(outside_tables(words, boxes))).withColumn("document_name", F.lit(name)), tables
    if source.lower().endswith((".json", ".jsonl")):
        return spark.read.schema(schemas.LINES).json(source), None
    return spark.read.schema(schemas.LINES).parquet(source), None


def index_command(spark: SparkSession, args: argparse.Namespace) -> None:
    name = args.name or args.source.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = args.out or f"data/processed/{slug(name)}"
    lines, tables = read_lines(spark, args.source, name)
    index = build_index(lines, tables, EngineConfig.from_session(spark))
    save_index(index, out)
    save_search(out, build_search(index, EngineConfig.from_session(spark)))
    print(f"{index.nodes.count()} nodes, {index.chunks.count()} chunks -> {out}")


def ask_command(spark: SparkSession, args: argparse.Namespace) -> None:
    if not index_exists(spark, args.index):
        sys.exit(f"no index at {args.index}")
    config, index = EngineConfig.from_session(spark), load_index(spark, args.index)
    search = load_search(spark, args.index)
    print(describe_provider(get_provider()))
    number = 0
    for line in sys.stdin:
        question = line.strip()
        if question.lower() in ("exit", "quit"):
            break
        if not question:
            continue
        number += 1
        row = answer_queries(index, spark.createDataFrame([(f"q{number}", question)], "query_id string, text string"), config, search=search).orderBy(F.desc("top_rerank_score")).first()
        print(row.answer)
        if args.verbose:
            print(*(f"  {s.stage}: {s.attrs}" for s in row.trace), sep="\n")


def evaluate_command(spark: SparkSession, args: argparse.Namespace) -> None:
    config = EngineConfig.from_session(spark)
    questions = read_questions(spark, args.questions).persist()
    name = questions.first().document_name
    lines, tables = read_lines(spark, args.source, name)
    index = build_index(lines, tables, config)
    baselines = compare_baselines(index, build_windows(lines, config), questions, args.top_k, config).persist()
    if args.skip_generation:
        print_tables(baselines)
        return
    provider = get_provider()
    rows = evaluate_answers(index, questions, config, provider).persist()
    rollup = rollup_rows(rows).persist()
    print_tables(baselines, rollup, rows)
    base = args.out or f"evaluation/results/{re.sub(r'[^a-z0-9]+', '-', name.lower()).strip('-')}_{datetime.datetime.now():%Y%m%d-%H%M%S}"
    write_json(report_json(name, describe_provider(provider), baselines, rows, rollup), f"{base}.json")
    write_csv(rows, f"{base}.csv")
    text = render_markdown(name, describe_provider(provider), rows, rollup)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}.md")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folio", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("index")
    p.add_argument("source")
    p.add_argument("--name")
    p.add_argument("--out")
    p.set_defaults(run=index_command)
    p = commands.add_parser("ask")
    p.add_argument("index")
    p.add_argument("--verbose", action="store_true")
    p.set_defaults(run=ask_command)
    p = commands.add_parser("evaluate")
    p.add_argument("source")
    p.add_argument("questions")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--out")
    p.add_argument("--skip-generation", action="store_true")
    p.set_defaults(run=evaluate_command)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("folio").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
