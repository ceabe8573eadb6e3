"""Rule-based analysis of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import NUMBER_TOKEN, STOP_QUERY, strings

# fixed values: what a stem in a question says about the sections to look in, and marker words
INTENTS = (
    ("terminat", ("termination", "termination for cause", "termination for convenience")),
    ("cancel", ("termination", "termination for convenience")),
    ("pay", ("payment", "fees", "invoice")),
    ("invoice", ("payment", "disputed invoices")),
    ("fee", ("fees", "payment")),
    ("confidential", ("confidentiality",)),
    ("liab", ("limitation of liability",)),
    ("indemn", ("indemnification", "insurance")),
    ("insur", ("insurance",)),
    ("notice", ("notices", "notice requirements")),
    ("compar", ("comparison",)),
)
COMPARISON = ("compare", "versus", " vs ", "difference between", "differ")
TEMPORAL = ("days", "months", "years", "deadline", "period", "notice period", "when")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(strings(words), lambda w: F.contains(text, w))


def analyze_queries(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, text, …) with keywords, explicit_section_refs, candidate_topics and three flags.

    Stems and topics are found as substrings, topics listed once in the order of the stems; keywords keep repeats.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-zA-Z']+"), F.lit(0))
    keywords = F.filter(words, lambda w: ~w.isin(*STOP_QUERY) & (F.length(w) > 2))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"section\s+({NUMBER_TOKEN})"), F.lit(1))))
    hit = [F.when(F.contains(low, F.lit(stem)), strings(topics)).otherwise(F.array().cast("array<string>")) for stem, topics in INTENTS]
    stems = sum((F.contains(low, F.lit(stem)).cast("int") for stem, _ in INTENTS), F.lit(0))
    out = queries.withColumns({"keywords": keywords, "explicit_section_refs": refs, "candidate_topics": F.array_distinct(F.concat(*hit)), "is_comparison": any_of(low, COMPARISON), "is_temporal": any_of(low, TEMPORAL)})
    return out.withColumn("is_multi_hop", (stems >= 2) | (F.contains(low, F.lit(" and ")) & (F.size("candidate_topics") >= 2)))
