"""Token, number and citation functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns that cut texts into tokens, numbers, headings, references and citations
#: Unicode white space, with the four separators that plain ``\s`` leaves out.
SPACES = "(?U)[\\s\\x1c-\\x1f]+"
TOKEN = "[a-zA-Z0-9$%]+"
NUMBER_TOKEN = r"\d+(?:\.\d+){0,3}"
SECTION_HEADING = r"^(\d+(?:\.\d+){0,4})\.?\s*[-–—]?\s*(.*)$"
CROSS_REFERENCE = r"[Ss]ections?\s+(\d+(?:\.\d+){0,3}(?:\([a-z]\))?(?:\s*,\s*\d+(?:\.\d+){0,3})*(?:\s*,?\s*(?:and|&)\s*\d+(?:\.\d+){0,3})?)"
ARTICLE_HEADING = r"^Article\s+(\d+)\s*\.?\s*$"
CLAUSE_START = r"^(\d+(?:\.\d+){1,4})\.?\s+"
CITATION = r"\[Source:[^\]]+\]"
CITATION_PARTS = r"\[Source:\s*([^,\]]+?)(?:,\s*Section\s+([\d.]+))?(?:,\s*Pages?\s+[\d\-]+)?\]"
NUMBER = r"\$?\d[\d,]*(?:\.\d+)?%?"
SENTENCE_END = r"(?<=[.;])\s+"
REFUSAL = "INSUFFICIENT EVIDENCE"

# fixed values: the word lists that each step leaves out
STOP_RERANK = ("the", "a", "an", "is", "are", "of", "to", "in", "and", "or", "for", "on", "what", "does", "do", "under", "this", "that")
STOP_METRICS = ("the", "a", "an", "is", "are", "of", "to", "in", "and", "or", "for", "on", "what", "does", "do", "under", "this", "that", "when", "how")
STOP_GROUND = ("the", "a", "an", "is", "are", "of", "to", "in", "and", "or", "for", "on", "not", "does", "do", "under", "this", "that", "shall", "be", "as", "it", "its", "with")
STOP_EXTRACT = ("the", "a", "an", "is", "are", "of", "to", "in", "and", "or", "for", "on", "what", "does", "do", "under", "this", "that", "when")
STOP_QUERY = (
    "the", "a", "an", "is", "are", "of", "to", "in", "and", "or", "for", "on", "what", "when", "how", "does", "do", "can", "under", "which", "if", "be",
    "this", "that", "with", "at", "by", "as", "it", "its",
)


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


#: The characters of ``SPACES``.
SPACE_CHARACTERS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(c: Column) -> Column:
    """Without white space at both ends, which are looked at alone, where a pattern would look at every place of the text."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def split_words(c: Column) -> Column:
    """Words between Unicode white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def tokens_of_words(n: Column) -> Column:
    """Approximate model tokens of ``n`` words, at least one."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(1.3)).cast("int"))


def approx_tokens(c: Column) -> Column:
    return tokens_of_words(word_count(c))


def tokens(c: Column) -> Column:
    """Lower-case search tokens in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def token_set(c: Column, stop: tuple[str, ...] = ()) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), strings(stop))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))


def cross_references(c: Column) -> Column:
    """Distinct section numbers that a text refers to, sorted as strings."""
    lists = F.regexp_extract_all(c, F.lit(CROSS_REFERENCE), F.lit(1))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(lists, lambda m: F.regexp_extract_all(m, F.lit(NUMBER_TOKEN), F.lit(0))))))
    # most texts hold no such word, which is seen without a pattern
    return F.when(F.contains(c, F.lit("ection")), found).otherwise(F.array().cast("array<string>"))


def citations(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(0))


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END)


def normalised(c: Column) -> Column:
    """Straight quotes, lower case, single spaces."""
    straight = F.translate(c, "‘’“”", "''\"\"")
    return F.array_join(split_words(F.lower(straight)), " ")


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("Page "), start)).otherwise(F.concat(F.lit("Pages "), start, F.lit("-"), end))


def citation(name: Column, section: Column, start: Column, end: Column) -> Column:
    place = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", Section "), section)).otherwise("")
    return F.concat(F.lit("[Source: "), name, place, F.lit(", "), page_label(start, end), F.lit("]"))


def is_refusal(answer: Column) -> Column:
    return F.startswith(F.upper(stripped(answer)), F.lit(REFUSAL))


def slug(name: Column) -> Column:
    """Lower case, each other character a hyphen, hyphens at the ends off."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")


def slug_collapsed(name: Column) -> Column:
    """As ``slug`` for report names, where a run of others is one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; values all alike become 1."""
    return F.when(low == high, 1.0).otherwise((value - low) / (high - low))


def nanos(score: Column) -> Column:
    """A score in whole billionths, by which rankings tell scores apart whatever the order of their sums; much cheaper than rounding."""
    return F.floor(score * 1e9 + 0.5)
