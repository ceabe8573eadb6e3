"""Lines of a page: words to lines, running headers and footers, body font size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import stripped

LINE_GAP = 2.5
TABLE_MARGIN = 2.0
BAND = 15.0


def outside_tables(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words that lie in no table box (document_id, page, bx0, btop, bx1, bbottom), with a small margin."""
    m = TABLE_MARGIN
    inside = (
        (words.document_id == boxes.document_id) & (words.page == boxes.page) & (boxes.bx0 - m <= words.x0) & (words.x1 <= boxes.bx1 + m)
        & (boxes.btop - m <= words.top) & (words.top <= boxes.bbottom + m)
    )
    return words.join(boxes, inside, "left_anti")


def assemble_lines(words: DataFrame) -> DataFrame:
    """Words to lines: (document_id, page, line_in_page, text, font_size, is_bold, y0).

    Words go by rounded top, then left edge. A word joins the open line if its top is near the top of the line's first
    word, so the anchor does not drift along a slanting line: an ordered fold over one page's words.
    """
    word = F.struct(F.bround("top", 1).alias("t"), "x0", "text", "top", F.coalesce("size", F.lit(10.0)).alias("size"), F.coalesce("fontname", F.lit("")).alias("font"))
    pages = words.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    # words of one top are on one line, so the fold goes over tops, of which a page has few; it gives the place of each line's first word
    pages = pages.withColumn("ts", F.transform("ws", lambda w: w["t"])).withColumn("tops", F.array_distinct("ts"))
    fold = """aggregate(tops, named_struct('anchor', cast(null as double), 'firsts', array(1)),
        (a, t) -> if(a.anchor is null or abs(t - a.anchor) <= {gap},
            named_struct('anchor', coalesce(a.anchor, t), 'firsts', a.firsts),
            named_struct('anchor', t, 'firsts', concat(a.firsts, array(cast(array_position(ts, t) as int))))), a -> a.firsts)""".format(gap=LINE_GAP)
    placed = pages.withColumn("firsts", F.expr(fold)).select("document_id", "page", "ws", F.posexplode(F.arrays_zip("firsts", F.slice(F.concat("firsts", F.array(F.size("ws") + 1)), F.lit(2), F.size("firsts")).alias("nexts"))).alias("line_in_page", "z"))
    lines = placed.select("document_id", "page", "line_in_page", F.slice("ws", F.col("z.firsts"), F.col("z.nexts") - F.col("z.firsts")).alias("w"))
    return lines.select(
        "document_id", "page", "line_in_page", stripped(F.array_join("w.text", " ")).alias("text"),
        F.bround(F.aggregate("w.size", F.lit(0.0), lambda a, x: a + x) / F.size("w"), 1).alias("font_size"),
        F.contains(F.lower(F.array_join("w.font", "\n")), F.lit("bold")).alias("is_bold"), F.element_at("w.top", 1).alias("y0"),
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Adds line_no, the reading order within a document."""
    order = Window.partitionBy("document_id").orderBy("page", "line_in_page")
    return lines.withColumn("line_no", F.row_number().over(order).cast("long")).drop("line_in_page")


def mask(text: Column) -> Column:
    return F.regexp_replace(stripped(text), r"\d+", "#")


def strip_running_lines(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Lines but for running headers and footers; ``documents`` has document_id and total_pages.

    A line runs if its text, digits masked, is on many pages at nearly one height. Documents under three pages keep all.
    """
    keyed = lines.withColumn("_key", mask(F.col("text"))).join(documents.select("document_id", "total_pages"), "document_id", "left")
    enough = F.greatest(F.lit(3), F.floor(F.col("total_pages") * 0.4).cast("int"))
    # windows, not a join with the lines that run: the lines are worked out once
    alike = Window.partitionBy("document_id", "_key")
    pages, band = F.size(F.collect_set("page").over(alike)), F.max("y0").over(alike) - F.min("y0").over(alike)
    runs = F.when(F.col("_key").isNotNull() & (F.col("total_pages") >= 3), (pages >= enough) & (band <= BAND))
    return keyed.withColumn("_runs", F.coalesce(runs, F.lit(False))).filter("not _runs").select(*lines.columns)


def body_font_sizes(lines: DataFrame) -> DataFrame:
    """(document_id, body_font_size): the commonest size of non-empty lines, of tied ones the first met."""
    shown = F.when(F.col("text") != "", F.col("line_no"))
    counted = lines.groupBy("document_id", "font_size").agg(F.count(shown).alias("n"), F.min(shown).alias("seen"))
    best = F.max_by("font_size", F.when(F.col("n") > 0, F.struct("n", -F.col("seen"))))
    return counted.groupBy("document_id").agg(F.coalesce(best, F.lit(10.0)).alias("body_font_size"))


def nonblank(lines: DataFrame) -> DataFrame:
    return lines.filter(stripped(F.col("text")) != "")


def lines_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of plain texts: one page, one font, the line's number as its height."""
    at = docs.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "text"))
    return at.select(
        "document_id", F.concat(F.lit("document "), "document_id").alias("document_name"), (F.col("pos") + 1).cast("long").alias("line_no"), F.lit(1).alias("page"),
        F.col("pos").cast("double").alias("y0"), F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"), "text",
    )


#: Font sizes that markup stands for; what is no heading has the size of a paragraph.
MARKUP_SIZES = {"h1": 18.0, "h2": 15.0, "h3": 13.0, "h4": 11.0, "h5": 11.0, "h6": 11.0}
BODY_SIZE = 10.0
#: What is no text, what begins a line, and what ends one beside the next beginning.
UNSEEN = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)[ \t\r\n\f]*>|<!--.*?-->"
BEGINS = r"(?i)(<(?:h[1-6]|p|li|blockquote|pre|dt|dd|td|th|caption|figcaption)(?:[ \t\r\n\f][^>]*)?>)"
ENDS = r"(?is)</(?:article|nav|footer|header|aside|section|main|body|html|table|ul|ol|dl|div)[ \t\r\n\f]*>.*"
BOLD = r"(?i)^<p(?:[ \t\r\n\f][^>]*)?><(?:b|strong)(?:[ \t\r\n\f][^>]*)?>"


def lines_of_markup(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Lines of markup, one for each heading, paragraph, list item, table cell, quote or caption: headings are larger,
    paragraphs that begin with ``<b>`` or ``<strong>`` bold. Scripts, styles and remarks are no text."""
    seen = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "\x01", ""), UNSEEN, "")
    cut = F.split(F.regexp_replace(seen, BEGINS, "\x01$1"), "\x01")
    # the first part is what comes before any line
    found = pages.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))).alias("pos", "part"))
    found = found.withColumn("raw", F.regexp_replace("part", ENDS, ""))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    size = F.coalesce(*(F.when(tag == k, v) for k, v in MARKUP_SIZES.items()), F.lit(BODY_SIZE))
    return found.select(
        "document_id", F.concat(F.lit("page "), "document_id").alias("document_name"), (F.col("pos") + 1).cast("long").alias("line_no"), F.lit(1).alias("page"),
        F.col("pos").cast("double").alias("y0"), size.alias("font_size"), F.col("raw").rlike(BOLD).alias("is_bold"),
        F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"),
    )
