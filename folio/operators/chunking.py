"""Chunks: clauses packed within a section, tables as markdown, and fixed word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions.text import CLAUSE_START, SENTENCE_END, approx_tokens, cross_references, split_words, stripped, tokens_of_words
from folio.operators.tree import ROOT, with_breadcrumbs


def clauses(text: Column) -> Column:
    """Clauses of a section's text: a line that begins with a dotted number starts one; a clause's lines are joined by spaces."""
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")
    def joined(acc: Column, line: Column) -> Column:
        starts = line.rlike(CLAUSE_START) | (F.size(acc) == 0)
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), F.lit("")), F.lit(" "), line)))
        return F.when(starts, F.concat(acc, F.array(line))).otherwise(longer)
    return F.aggregate(lines, F.array().cast("array<string>"), joined)


def sized_pieces(pieces: str) -> str:
    """SQL: array of (text, tokens) of an array of texts."""
    count = "size(filter(split({0}, '(?U)[\\\\s\\\\x1c-\\\\x1f]+'), w -> w <> ''))".format("t")
    return f"transform({pieces}, t -> named_struct('t', t, 'n', greatest(1, cast(floor({count} * 1.3D) as int))))"


def packed(config: EngineConfig) -> str:
    """SQL fold over an array ``units`` of (t, n, parts): the groups of texts that chunks are made of.

    Clauses go to the open group until it would pass the limit, which closes it unless it is still small. A clause over
    the limit closes the open group; its sentences are packed by themselves, without the lower limit.
    """
    most, least = config.chunk_max_tokens, config.chunk_min_tokens
    empty = "cast(array() as array<string>)"
    inner = f"""aggregate(u.parts, named_struct('gs', a.gs, 'g', {empty}, 'n', 0),
        (b, p) -> if(b.n + p.n > {most} and size(b.g) > 0,
            named_struct('gs', concat(b.gs, array(b.g)), 'g', array(p.t), 'n', p.n),
            named_struct('gs', b.gs, 'g', concat(b.g, array(p.t)), 'n', b.n + p.n)),
        b -> if(size(b.g) > 0, concat(b.gs, array(b.g)), b.gs))"""
    closed = "if(size(a.g) > 0, concat(a.gs, array(a.g)), a.gs)"
    return f"""aggregate(units, named_struct('gs', cast(array() as array<array<string>>), 'g', {empty}, 'n', 0),
        (a, u) -> if(u.n > {most},
            named_struct('gs', {inner.replace("'gs', a.gs", f"'gs', {closed}")}, 'g', {empty}, 'n', 0),
            if(a.n + u.n > {most} and a.n >= {least},
                named_struct('gs', concat(a.gs, array(a.g)), 'g', array(u.t), 'n', u.n),
                named_struct('gs', a.gs, 'g', concat(a.g, array(u.t)), 'n', a.n + u.n))),
        a -> {closed})"""


def with_groups(df: DataFrame, text: str, config: EngineConfig) -> DataFrame:
    """Adds ``groups``, arrays of texts per chunk, of a section's text."""
    df = df.withColumn("_clauses", F.when(stripped(F.col(text)) != "", clauses(F.col(text))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_sized", F.expr(sized_pieces("_clauses")))
    parts = sized_pieces(f"split(c.t, '{SENTENCE_END.replace(chr(92), chr(92) * 2)}')")
    units = f"transform(_sized, c -> named_struct('t', c.t, 'n', c.n, 'parts', if(c.n > {config.chunk_max_tokens}, {parts}, cast(array() as array<struct<t: string, n: int>>))))"
    return df.withColumn("units", F.expr(units)).withColumn("groups", F.expr(packed(config))).drop("_clauses", "_sized", "units")


def chunk_nodes(nodes: DataFrame, documents: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks of all sections but the root, so text before the first heading is in none.

    From the second on, a chunk begins with the last words of the one before, as that was without its own overlap.
    """
    named = with_breadcrumbs(nodes).filter(F.col("node_id") != ROOT).join(documents.select("document_id", "document_name"), "document_id")
    rows = with_groups(named, "raw_text", config).select("*", F.posexplode("groups").alias("i", "group")).drop("groups")
    words = int(config.chunk_overlap_tokens / 1.3)
    body = F.array_join("group", " ")
    before = F.lag(F.array_join("group", " ")).over(Window.partitionBy("document_id", "node_id").orderBy("i"))
    tail = F.expr(f"slice(_w, greatest(size(_w) - {words - 1}, 1), {words})")
    rows = rows.withColumn("_body", stripped(body)).withColumn("_w", split_words(before))
    source = F.when((F.lit(words) > 0) & (F.size("_w") > 0), F.concat(F.array_join(tail, " "), F.lit(" "), F.col("_body"))).otherwise(F.col("_body"))
    rows = rows.withColumn("source_text", source)
    display = F.concat(F.lit("["), "breadcrumb", F.lit("]\n"), "source_text") if config.chunk_include_section_title else F.col("source_text")
    clause = (F.size("group") == 1) & F.element_at("group", 1).rlike(CLAUSE_START)
    return rows.select(
        F.concat("node_id", F.lit("-chunk-"), F.col("i") + 1).alias("chunk_id"), "document_id", "document_name", F.col("node_no").alias("_major"), F.col("i").alias("_minor"),
        F.when(clause, "clause").otherwise("paragraph").alias("chunk_type"), "node_id", "section_number", F.col("title").alias("section_title"), "parent_section",
        F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"), "source_text", display.alias("display_text"),
        approx_tokens(F.col("source_text")).alias("token_count"), cross_references(F.col("source_text")).alias("referenced_sections"), F.lit(None).cast("string").alias("table_id"),
    )


def table_markdown(headers: Column, rows: Column) -> Column:
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, bar)
    ruled = F.concat(F.array(bar(headers), bar(F.transform(headers, lambda _: F.lit("---")))), body)
    return F.when(F.size(headers) == 0, F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")).otherwise(F.array_join(ruled, "\n"))


def chunk_tables(tables: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """A chunk per table, held by the section in which it stands, else by the root."""
    owner = nodes.select("document_id", "node_id", "section_number", F.col("title").alias("section_title"), F.explode("table_ids").alias("table_id"))
    rows = tables.join(owner, ["document_id", "table_id"], "left").join(documents.select("document_id", "document_name"), "document_id").withColumn("md", table_markdown(F.col("headers"), F.col("rows")))
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat("table_id", F.lit("-chunk")).alias("chunk_id"), "document_id", "document_name", F.lit(1 << 40).alias("_major"), F.col("table_no").alias("_minor"), F.lit("table").alias("chunk_type"),
        F.coalesce("node_id", F.lit(ROOT)).alias("node_id"), "section_number", "section_title", none.alias("parent_section"), F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        F.col("md").alias("source_text"), F.col("md").alias("display_text"), approx_tokens(F.col("md")).alias("token_count"), F.array().cast("array<string>").alias("referenced_sections"), "table_id",
    )


def chunk_documents(nodes: DataFrame, documents: DataFrame, tables: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """All chunks with chunk_no, their order in a document: sections in order, then tables."""
    rows = chunk_nodes(nodes, documents, config)
    if tables is not None:
        rows = rows.unionByName(chunk_tables(tables, nodes, documents))
    order = Window.partitionBy("document_id").orderBy("_major", "_minor")
    return rows.withColumn("chunk_no", F.row_number().over(order).cast("long")).drop("_major", "_minor")


def fixed_windows(lines: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Overlapping windows of words over whole documents, blind to sections; the last may be short.

    Words are numbered by summing line lengths, so only line counts pass through the window function; each word then
    goes to the few windows that hold it.
    """
    size, step = config.window_words, max(1, config.window_words - config.window_overlap)
    order = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_w", split_words(F.col("text"))).withColumn("_n", F.size("_w")).withColumn("_at", F.coalesce(F.sum("_n").over(order), F.lit(0)).cast("long"))
    # a line is cut once for each window that meets it, so whole slices travel instead of words
    rows = rows.filter("_n > 0")
    low = F.greatest(F.lit(0), F.ceil((F.col("_at") - (size - 1)) / step)).cast("long")
    high = F.floor((F.col("_at") + F.col("_n") - 1) / step).cast("long")
    cut = rows.select("document_id", "document_name", "line_no", "page", "_w", "_at", "_n", F.explode(F.sequence(low, high)).alias("win"))
    begin = F.greatest(F.lit(0), F.col("win") * step - F.col("_at"))
    end = F.least(F.col("_n").cast("long"), F.col("win") * step + size - F.col("_at"))
    cut = cut.withColumn("_b", begin.cast("int")).withColumn("_e", end.cast("int")).filter("_e > _b")
    cut = cut.select("document_id", "document_name", "line_no", "page", "win", F.slice("_w", F.col("_b") + 1, F.col("_e") - F.col("_b")).alias("part"))
    text = F.array_join(F.flatten(F.sort_array(F.collect_list(F.struct("line_no", "part")))["part"]), " ")
    rows = cut.groupBy("document_id", "win").agg(F.first("document_name").alias("document_name"), text.alias("source_text"), F.sum(F.size("part")).alias("words"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return rows.select(
        F.concat("document_id", F.lit("-fixed-"), F.col("win") + 1).alias("chunk_id"), "document_id", "document_name", (F.col("win") + 1).alias("chunk_no"), F.lit("paragraph").alias("chunk_type"),
        F.lit("flat").alias("node_id"), F.lit(None).cast("string").alias("section_number"), F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("parent_section"),
        "page_start", "page_end", "source_text", F.col("source_text").alias("display_text"), F.floor(F.col("words") * F.lit(1.3)).cast("int").alias("token_count"),
        F.array().cast("array<string>").alias("referenced_sections"), F.lit(None).cast("string").alias("table_id"),
    )


def text_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: EngineConfig = EngineConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, chunk_id, chunk_no, words, source_text, and columns to ``keep``) of plain texts, one row a document: the windows that ``fixed_windows`` makes of their lines.

    Windows are blind to lines, so a text is cut where it stands and nothing is shuffled.
    """
    size, step = config.window_words, max(1, config.window_words - config.window_overlap)
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), *keep, split_words(F.col(text_col)).alias("_w")).withColumn("_n", F.size("_w")).filter("_n > 0")
    texts = F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / step).cast("int")), lambda k: F.array_join(F.slice("_w", k * step + 1, F.lit(size)), " "))
    cut = rows.select("document_id", *keep, "_n", F.posexplode(texts).alias("win", "source_text"))
    return cut.select(
        "document_id", F.concat("document_id", F.lit("-fixed-"), F.col("win") + 1).alias("chunk_id"), (F.col("win") + 1).cast("long").alias("chunk_no"),
        F.least(F.lit(size), F.col("_n") - F.col("win") * step).cast("long").alias("words"), "source_text", *keep,
    )


def as_chunks(windows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``text_windows`` with the columns that chunks have, all of which follow from them."""
    none = F.lit(None).cast("string")
    return windows.select(
        "chunk_id", "document_id", F.concat(F.lit("document "), "document_id").alias("document_name"), "chunk_no", F.lit("paragraph").alias("chunk_type"), F.lit("flat").alias("node_id"), none.alias("section_number"),
        none.alias("section_title"), none.alias("parent_section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "source_text", F.col("source_text").alias("display_text"),
        F.floor(F.col("words") * F.lit(1.3)).cast("int").alias("token_count"), F.array().cast("array<string>").alias("referenced_sections"), none.alias("table_id"), *keep,
    )
