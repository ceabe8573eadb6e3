"""Headings, paragraphs and table anchors in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import ARTICLE_HEADING, SECTION_HEADING, cross_references, stripped, word_count

HEADING, PARAGRAPH, ANCHOR = "heading", "paragraph", "table_anchor"


def heading(text: Column, font_size: Column, bold: Column, body: Column) -> Column:
    """Struct (section_number, title, depth) of a heading line, else null.

    Tried in turn: a numbered title, which must have a letter and at most 20 words and be bold or larger than the body;
    a short line in capitals, larger than the body, without digits; a line ``Article n``, which always nests at depth 2.
    A line that looks numbered but fails on letters or words is no heading at all; one that fails on its font goes on.
    """
    t = stripped(text)
    number = F.regexp_extract(t, SECTION_HEADING, 1)
    rest = stripped(F.regexp_extract(t, SECTION_HEADING, 2))
    numbered = number != ""
    barred = numbered & (~rest.rlike("[a-zA-Z]") | (word_count(t) > 20))
    larger = font_size > body + 0.4
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (word_count(t) <= 8) & larger & ~t.rlike(r"\d") & ~t.rlike("^[$€£]")
    article = F.regexp_extract(t, ARTICLE_HEADING, 1)
    def made(n: Column, title: Column, depth: Column) -> Column:
        return F.struct(n.cast("string").alias("section_number"), title.cast("string").alias("title"), depth.cast("int").alias("depth"))
    none = F.lit(None)
    # no line of the body's size is a heading unless it is bold, so most lines meet no pattern
    return F.when(bold | (font_size > body + 0.2), (
        F.when((t == "") | barred, none)
        .when(numbered & (larger | bold), made(number, rest, dots(number) + 1))
        .when(capitals, made(none, t, F.lit(1)))
        .when((article != "") & ((font_size > body + 0.2) | bold), made(article, none, F.lit(2)))
    ))


def dots(number: Column) -> Column:
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))


def detect_structure(lines: DataFrame, body: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Blocks of documents: a block per non-blank line, and an anchor per table where it stands in reading order.

    An anchor goes before the first line that is below it, else to the end. Anchors at one place keep the order in which
    inserting them one after another would leave them: by page, height and number.
    """
    shown = lines.filter(stripped(F.col("text")) != "").join(body, "document_id")
    h = heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("body_font_size"))
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = shown.withColumn("h", h).withColumn("at", F.row_number().over(order)).select(
        "document_id", F.col("at").cast("long"), F.lit(1).alias("kind"), F.when(F.col("h").isNotNull(), HEADING).otherwise(PARAGRAPH).alias("block_type"), "text", "page", "y0",
        F.when(F.col("h").isNotNull(), F.col("h.depth")).otherwise(0).alias("depth"), F.col("h.section_number").alias("section_number"), F.col("h.title").alias("title"),
        F.when(F.col("h").isNull(), cross_references(F.col("text"))).alias("referenced_sections"), F.lit(None).cast("string").alias("table_id"), F.lit(0).alias("table_no"),
    )
    if tables is not None:
        given = tables.select("document_id", "page", "y0", "table_id", "table_no").distinct()
        anchors = given.select(
            "document_id", F.lit(None).cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(ANCHOR).alias("block_type"),
            F.concat(F.lit("[table:"), "table_id", F.lit("]")).alias("text"), "page", "y0", F.lit(0).alias("depth"),
            F.lit(None).cast("string").alias("section_number"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("referenced_sections"), "table_id", "table_no",
        )
        # from the end backwards, a table meets the least number of the lines below it: one pass over a document, no pairs
        upwards = Window.partitionBy("document_id").orderBy(F.desc("page"), F.desc("y0"), "kind").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.unionByName(anchors).withColumn("at", F.when(F.col("kind") == 0, F.coalesce(F.min("at").over(upwards), F.lit(1 << 60))).otherwise(F.col("at")))
    reading = Window.partitionBy("document_id").orderBy("at", "kind", F.when(F.col("kind") == 0, F.struct("page", "y0", "table_no")))
    return rows.withColumn("block_no", F.row_number().over(reading).cast("long")).select(
        "document_id", "block_no", "block_type", "text", "page", "y0", "depth", "section_number", "title", "referenced_sections", "table_id"
    )
