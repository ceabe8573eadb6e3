"""Licence scan: canonical digests of whole texts and of single lines, looked up among known licences.

Canonical form: what names a copyright holder goes, letters A-Z become small, equivalent spellings become one, and all
between words and digits becomes one space, line ends too, so it does not matter where a text is wrapped. Two texts with the
same canonical form have the same SHA-256 digest, so known licences are found by an equi-join. Everything runs as Spark
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, scratch, sized, written
from folio.llm.full_licenses import full_texts
from folio.llm.license_texts import KNOWN

#: Spellings that count as one, as (pattern, replacement) over a lower-case line.
EQUIVALENT = (
    (r"licenc", "licens"),
    (r"(favo|hono|labo)ur", r"$1r"),
    (r"(author|organ|util|recogn|capital|initial)is(e|ation|ing)", r"$1iz$2"),
    (r"https?://", ""),
)
#: The same over the words of a text, for spellings and phrases that may be cut by a line end.
ACROSS = ((r"\bsub licens", "sublicens"), (r"\bnon infring", "noninfring"), (r"\ball rights reserved\b", ""), (r" +", " "))
#: What names a holder at a line's start, after any comment marks: a copyright word or sign, then a year, a place for one
#: or the sign; up to the line's end, or to a full stop after which a sentence of a licence begins, which stays.
HOLDER = (
    r"^[ \t#*/;%!<>|.-]*(?:copyright[ \t]*(?:\(c\)|©|&copy;)|copyright[ \t]+(?:by[ \t]+)?[\[<{(]?(?:[0-9]{4}|year|yyyy)|(?:\(c\)|©|&copy;)[ \t]*(?:copyright)?[ \t]*[\[<{(]?(?:[0-9]{4}|year|yyyy))"
    r"[^\n]*?(?:$|\.[ \t]+((?:permission|redistribution|licen[cs]ed|released|all rights reserved|this (?:software|work|file|program))[^\n]*$))"
)
#: Whatever is not a letter, a digit or beyond ASCII, and the marks beyond ASCII that stand for such.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ©‐-―‘-‟•…]+"


def words_only(line: Column) -> Column:
    """Canonical form of a lower-case line."""
    for pattern, to in EQUIVALENT:
        line = F.regexp_replace(line, pattern, to)
    return F.trim(F.regexp_replace(line, BETWEEN, " "))


def line_forms(text: Column) -> Column:
    """For each line of a text its canonical form ``whole``, and ``rest``, that without what names a holder; null counts as empty."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n")
    return F.transform(lines, lambda x: F.struct(words_only(x).alias("whole"), F.when(x.rlike(HOLDER), words_only(F.regexp_replace(x, HOLDER, "$1"))).alias("named")))


def joined(forms: Column) -> Column:
    """Canonical form of a text from those of its lines."""
    c = F.array_join(F.filter(forms, lambda f: f != ""), " ")
    for pattern, to in ACROSS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def rest(form: Column) -> Column:
    return F.coalesce(form["named"], form["whole"])


def canonical_text(text: Column) -> Column:
    """Canonical form of a text without its holders."""
    return joined(F.transform(line_forms(text), rest))


def canonical_whole(text: Column) -> Column:
    """Canonical form of a text with its holders, the same wherever it is wrapped."""
    return joined(F.transform(line_forms(text), lambda f: f["whole"]))


def known_digests(spark: SparkSession, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, licence, size) of ``texts``, else of the short texts and notices and the full texts that ship with this package.

    Each text is known by its form without holders and by that with them. Size is the form's length; of two licences with
    one form the first name by order counts.
    """
    rows = spark.createDataFrame(list(KNOWN + full_texts() if texts is None else texts), "licence string, text string")
    forms = rows.select("licence", F.explode(F.array(canonical_text(F.col("text")), canonical_whole(F.col("text")))).alias("form"))
    return forms.filter("form <> ''").groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).agg(F.min("licence").alias("licence"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of the whole canonical text, the licence it is (else null), licences that single lines are.

    The digest is that of the form without holders. A text is a licence if that form is known, or if the form with holders
    is: texts that name their own steward, as the GNU licences do, are so found wherever they are wrapped.
    ``line_licences`` is sorted and comma-separated, empty if no line is a known text. A null or empty text, or one of
    nothing but holders and punctuation, has a null digest and no licence. Repeated rows repeat; an empty table
    stays empty; other columns are ignored.

    Whole texts meet the known digests in hash joins on the digest: the known ones go to the documents if they are few, and
    else documents without a digest, which meet none, are dealt by their ids instead of to one task. Lines meet the known forms, of whatever length, where they are,
    by their canonical form's digest, so no line is shuffled; a line counts once however often a text repeats it.
    """
    known = written(known.select("digest", "licence", "size"), scratch(docs.sparkSession, "licences"))
    lines = known.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("digest", "licence"))).alias("by_digest"), F.collect_set("size").alias("sizes"))
    # the row of known digests is bounded by the number of known licences
    texts = docs.select(F.col(id_col), line_forms(F.col(text_col)).alias("forms")).crossJoin(F.broadcast(lines))
    texts = texts.withColumn("rests", F.transform("forms", rest))
    found = F.transform(
        F.filter(F.array_distinct("rests"), lambda f: F.array_contains("sizes", F.length(f))), lambda f: F.element_at("by_digest", F.sha2(f, 256))
    )
    text = joined(F.col("rests"))
    named = F.exists("forms", lambda f: f["named"].isNotNull())
    scanned = texts.select(
        id_col,
        F.sha2(F.nullif(text, F.lit("")), 256).alias("digest"),
        F.when(named, F.sha2(joined(F.transform("forms", lambda f: f["whole"])), 256)).alias("with_holders"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",").alias("line_licences"),
    )
    digests = sized(known.select("digest", "licence"))
    first, second = (digests.select(F.col("digest").alias(f"of_{k}"), F.col("licence").alias(f"by_{k}")) for k in ("rest", "whole"))
    apart = F.concat(F.lit("none "), F.xxhash64(id_col).cast("string"))
    met = scanned.join(first, F.coalesce("digest", apart) == F.col("of_rest"), "left").join(second, F.coalesce("with_holders", apart) == F.col("of_whole"), "left")
    return met.select(id_col, "digest", F.coalesce("by_rest", "by_whole").alias("licence"), "line_licences")
