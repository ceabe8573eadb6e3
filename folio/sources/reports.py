"""Report sinks: JSON, CSV and Markdown for evaluation rows, and tables for the console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the columns of the CSV report in order
CSV_COLUMNS = (
    "question_id", "category", "question", "expected_answer", "reference_passage", "answer", "answer_source", "is_answerable", "correctly_handled_answerability", "answer_correctness",
    "context_precision", "context_recall", "answer_relevance", "faithfulness", "top_rerank_score", "citations", "context_sections", "context_tokens", "input_tokens", "output_tokens",
    "latency_s", "groundedness_issues", "used_mock_fallback", "expected_keywords", "notes",
)
LISTS = ("citations", "context_sections", "expected_keywords")
TEXTS = ("answer", "reference_passage", "expected_answer")


def report_json(document: str, provider: str, baselines: DataFrame, rows: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row, ``value``: the whole report as a JSON text. Rows number as many as questions do."""
    packed = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    overall = rollup.filter("category is null").drop("category")
    parts = packed(baselines, "baselines").crossJoin(packed(rows, "rows")).crossJoin(packed(rollup.filter("category is not null"), "by_category")).crossJoin(packed(overall, "overall"))
    rag = F.struct(F.element_at("overall", 1).alias("overall"), F.map_from_entries(F.transform("by_category", lambda c: F.struct(c["category"], c))).alias("by_category"), "rows")
    return parts.select(F.to_json(F.struct(F.lit(document).alias("document"), F.size("rows").alias("n_questions"), F.lit(provider).alias("llm_provider"), "baselines", rag.alias("rag_evaluation"))).alias("value"))


def write_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def csv_rows(rows: DataFrame) -> DataFrame:
    """The CSV columns as text: lists joined, carriage returns out."""
    def shown(c: str):
        if c in LISTS:
            return F.array_join(c, " | ").alias(c)
        return F.replace(F.col(c), F.lit("\r"), F.lit(" ")).alias(c) if c in TEXTS else F.col(c)
    return rows.select(*map(shown, CSV_COLUMNS))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a byte-order mark, which spreadsheet programs look for before they take a file for UTF-8."""
    named = csv_rows(rows)
    marked = named.withColumnRenamed(CSV_COLUMNS[0], "\ufeff" + CSV_COLUMNS[0])
    marked.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def markdown_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``markdown``, a readable section per question."""
    n2 = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    flag = F.when(F.col("answer_source") == "gate_refusal", "REFUSED by relevance gate").when(F.col("answer_source") == "llm_refusal", "REFUSED by LLM").otherwise(F.col("answer_source"))
    source = F.when(F.col("reference_passage") != "", F.concat(F.lit("\n\n> "), F.replace(F.col("reference_passage"), F.lit("\n"), F.lit("\n> ")))).when(F.col("is_answerable"), " _(not found)_").otherwise(" _(none: the question is meant to have no answer)_")
    text = F.concat(
        F.lit("## "), "question_id", F.lit(" · "), "category", F.lit(" · "), flag, F.lit("\n\n**Question:** "), "question",
        F.when(F.col("expected_answer") != "", F.concat(F.lit("\n\n**Expected answer:** "), "expected_answer")).otherwise(""),
        F.lit("\n\n**Source passage:**"), source, F.lit("\n\n**Answer:** "), "answer",
        F.lit("\n\n- correctness "), n2("answer_correctness"), F.lit(", relevance "), n2("answer_relevance"), F.lit(", faithfulness "), n2("faithfulness"),
        F.lit(", context precision "), n2("context_precision"), F.lit(", recall "), n2("context_recall"),
        F.lit("\n- top rerank score "), n2("top_rerank_score"), F.lit(", context tokens "), F.col("context_tokens").cast("string"), F.lit("\n- context: "),
        F.when(F.size("context_sections") > 0, F.array_join("context_sections", ", ")).otherwise("(nothing)"),
        F.when(F.col("groundedness_issues") != "", F.concat(F.lit("\n- groundedness issues: "), "groundedness_issues")).otherwise(""),
        F.when(F.col("notes") != "", F.concat(F.lit("\n- note: "), "notes")).otherwise(""), F.lit("\n"),
    )
    return rows.withColumn("markdown", text)


def render_markdown(document: str, provider: str, rows: DataFrame, rollup: DataFrame, order: str = "question_id") -> str:
    """The whole review, put together on the driver: as many sections as there are questions."""
    o = rollup.filter("category is null").first()
    head = [f"# Evaluation review: {document}", "", f"Provider: **{provider}**  ", f"Questions: {o.n}  ", f"Wrongly refused: **{o.wrongly_refused}** (gate {o.wrongly_refused_by_gate}, model {o.wrongly_refused_by_llm})  ", f"Correctness when answered: **{o.correctness_when_answered:.2f}**", ""]
    return "\n".join([*head, *(r.markdown for r in markdown_rows(rows).orderBy(order).select("markdown").toLocalIterator())])


def print_tables(baselines: DataFrame, rollup: DataFrame | None = None, rows: DataFrame | None = None) -> None:
    """Console tables: baselines, means by category, questions refused although they have an answer."""
    r = lambda df, keep: df.select(*[c if c in keep else F.round(c, 3).alias(c) for c in df.columns])
    r(baselines, ("baseline_id", "name", "n_questions")).orderBy("baseline_id").show(truncate=False)
    if rollup is not None:
        r(rollup, ("category", "n")).orderBy(F.col("category").isNull(), "category").show(100, truncate=False)
    if rows is not None:
        rows.filter("is_answerable and answer_source <> 'answered'").select("question_id", "category", "answer_source", F.round("top_rerank_score", 2).alias("top_rerank_score")).orderBy("question_id").show(200, truncate=False)
