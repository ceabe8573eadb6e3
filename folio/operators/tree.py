"""The section tree: nodes, ancestors, page ranges, summaries, and search over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import stripped
from folio.sources.scratch import BUCKET, by_key, in_buckets, of_keys, sized, stored

ROOT = "root"
#: Section numbers have at most five parts, so a node has at most this many ancestors below the root.
MAX_DEPTH = 5
SUMMARY_CHARS = 240


def build_nodes(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes of each document's tree; ``documents`` has document_id and document_name.

    A heading's parent is the nearest heading before it that is less deep, else the root. A line or table belongs to the
    latest heading before it, else to the root. Windows by document carry the latest heading of each depth, so no
    heading meets another in a join. ``path`` has the numbers of a node's ancestors from below the root.
    """
    order = Window.partitionBy("document_id").orderBy("block_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_heading = F.col("block_type") == "heading"
    n = F.sum(is_heading.cast("int")).over(upto)
    rows = blocks.withColumn("node_no", n.cast("long")).withColumn("node_id", F.when(F.col("node_no") > 0, F.concat("document_id", F.lit("-node-"), "node_no")).otherwise(ROOT))
    # the latest heading of each depth so far is open if none less deep came after it; the open ones above a heading are
    # its ancestors
    latest = [F.last(F.when(is_heading & (F.col("depth") == d), F.col("node_no")), ignorenulls=True).over(before) for d in range(1, MAX_DEPTH + 1)]
    rows = rows.withColumn("_latest", F.array(*latest))
    above = F.expr("filter(_latest, (x, k) -> x is not null and k + 1 < depth and not exists(slice(_latest, 1, k), y -> y is not null and y > x))")
    rows = rows.withColumn("path", F.when(is_heading, above))
    # a heading, its lines and its tables meet in one grouping, so the blocks are worked out once
    head = F.struct(
        F.coalesce("title", "text").alias("title"), "section_number", "depth",
        F.when(F.size("path") > 0, F.concat("document_id", F.lit("-node-"), F.element_at("path", -1))).otherwise(ROOT).alias("parent_id"), "path", F.col("page").alias("page_start"),
    )
    is_text, is_table = F.col("block_type") == "paragraph", F.col("block_type") == "table_anchor"
    parts = rows.select(
        "document_id", "node_id", "node_no", F.when(is_heading, head).alias("head"), F.when(is_text, F.struct("block_no", "text", F.col("referenced_sections").alias("refs"))).alias("line"),
        F.when(is_text, F.col("page")).alias("page"), F.when(is_table, F.struct("block_no", "table_id")).alias("held"),
    )
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    # field by field, since a field that no heading leaves null takes no null in a cast of the whole
    root = F.struct(F.col("document_name").alias("title"), *(F.lit(0 if f.name == "depth" else None).cast(f.dataType).alias(f.name) for f in kinds["head"].fields[1:]))
    roots = documents.select("document_id", F.lit(ROOT).alias("node_id"), F.lit(0).cast("long").alias("node_no"), root.alias("head"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("line", "page", "held")))
    every = parts.unionByName(roots).groupBy("document_id", "node_id").agg(
        F.max("node_no").alias("node_no"), F.first("head", ignorenulls=True).alias("head"), F.sort_array(F.collect_list("line")).alias("lines"), F.max("page").alias("last_page"), F.sort_array(F.collect_list("held")).alias("tables")
    ).filter("head is not null")
    none = F.array().cast("array<string>")
    refs = F.array_distinct(F.flatten("lines.refs"))
    return every.select(
        "document_id", "node_id", "node_no", "head.title", "head.section_number", "head.depth", "head.parent_id", "head.path", "head.page_start", F.greatest("head.page_start", "last_page").alias("page_end"),
        F.coalesce(stripped(F.array_join("lines.text", "\n")), F.lit("")).alias("raw_text"), F.coalesce(refs, none).alias("referenced_sections"), F.col("tables.table_id").alias("table_ids"),
    )


def ancestry() -> Column:
    """A node's id and those of its ancestors, nearest first, up to the root; each node knows its path, so nothing is joined."""
    own = F.transform(F.reverse("path"), lambda n: F.concat("document_id", F.lit("-node-"), n))
    return F.when(F.col("node_id") == ROOT, F.array("node_id")).otherwise(F.concat(F.array("node_id"), own, F.array(F.lit(ROOT))))


def closure(nodes: DataFrame) -> DataFrame:
    """(document_id, ancestor_id, node_id, distance), each node with itself at 0, up to the root."""
    return nodes.select("document_id", F.posexplode(ancestry()).alias("distance", "ancestor_id"), "node_id")


def with_ranges_and_children(nodes: DataFrame) -> DataFrame:
    """``nodes`` with page ranges that span their descendants, where 0 and null do not count, and child_ids and child_titles in order.

    Each node tells its pages to its ancestors and its title to its parent: one grouping, and no joins of nodes with nodes.
    """
    own = F.struct(*(c for c in nodes.columns if c not in ("document_id", "page_start", "page_end")))
    told = nodes.select("document_id", own.alias("own"), F.nullif("page_start", F.lit(0)).alias("s"), F.nullif("page_end", F.lit(0)).alias("e"), F.posexplode(ancestry()).alias("distance", "to"))
    told = told.select("document_id", "to", "s", "e", F.when(F.col("distance") == 0, F.col("own")).alias("own"), F.when(F.col("distance") == 1, F.struct("own.node_no", "own.node_id", "own.title")).alias("kid"))
    met = told.groupBy("document_id", "to").agg(F.first("own", ignorenulls=True).alias("own"), F.min("s").alias("page_start"), F.max("e").alias("page_end"), F.sort_array(F.collect_list("kid")).alias("k"))
    return met.filter("own is not null").select("document_id", "own.*", "page_start", "page_end", F.col("k.node_id").alias("child_ids"), F.col("k.title").alias("child_titles"))


def with_summaries(nodes: DataFrame) -> DataFrame:
    """Adds ``summary``: child titles of the root and of parents, the beginning of a leaf's text."""
    titles = F.array_join("child_titles", ", ")
    text = stripped(F.col("raw_text"))
    covers = F.concat("title", F.lit(". Covers: "), titles, F.lit("."))
    includes = F.substring(F.concat("title", F.lit(". Includes: "), titles, F.lit(".")), 1, SUMMARY_CHARS)
    leaf = F.when(F.length(text) > SUMMARY_CHARS, F.concat(F.substring(text, 1, SUMMARY_CHARS), F.lit("…"))).otherwise(text)
    has = F.size("child_titles") > 0
    return nodes.withColumn("summary", F.when(F.col("node_id") == ROOT, F.when(has, covers).otherwise(F.col("title"))).when(has, includes).otherwise(leaf))


def with_breadcrumbs(nodes: DataFrame) -> DataFrame:
    """Adds ``breadcrumb``, titles from below the root down to the node, and ``parent_section``, null right under the root.

    The ancestors of a node are the latest nodes of their depths before it, so one pass over a document has their titles at hand.
    """
    before = Window.partitionBy("document_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)
    below_root = F.col("node_id") != ROOT
    latest = [F.last(F.when(below_root & (F.col("depth") == d), F.struct("node_no", "title")), ignorenulls=True).over(before) for d in range(1, MAX_DEPTH + 1)]
    titles = F.expr("transform(filter(_latest, x -> array_contains(path, x.node_no)), x -> x.title)")
    above = nodes.withColumn("_latest", F.array(*latest)).withColumn("_above", F.when(below_root, titles))
    crumbs = F.when(below_root, F.array_join(F.concat("_above", F.array("title")), " > ")).otherwise("")
    parent = F.when(F.size("path") > 0, F.element_at("_above", -1))
    return above.withColumn("breadcrumb", crumbs).withColumn("parent_section", parent).drop("_latest", "_above")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, ancestor_ids), nearest first, up to the root."""
    return nodes.select("document_id", "node_id", ancestor_ids().alias("ancestor_ids"))


def ancestor_ids() -> Column:
    """The ids of a node's ancestors, nearest first, up to the root, as its own row tells them."""
    return F.slice(ancestry(), F.lit(2), F.size(ancestry()))


def first_by_section(nodes: DataFrame) -> DataFrame:
    """(document_id, section_number, node_id): the first node with each number."""
    return nodes.filter("section_number is not null").groupBy("document_id", "section_number").agg(F.min_by("node_id", "node_no").alias("node_id"))


def descendant_chunks(nodes: DataFrame, chunks: DataFrame, with_tables: bool = False) -> DataFrame:
    """(document_id, node_id, chunk_id, path): chunks of a node and all below it; ``path`` sorts them in tree order.

    Table chunks belong to no node unless asked for.
    """
    texts = (chunks if with_tables else chunks.filter("table_id is null")).select("document_id", F.col("node_id").alias("holder"), "chunk_id", "chunk_no")
    paths = closure(nodes).select("document_id", F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("holder"))
    # headings are numbered in reading order, which is the order of a walk through the tree, so chunk numbers keep it
    return paths.join(texts, ["document_id", "holder"]).select("document_id", "node_id", "chunk_id", F.col("chunk_no").alias("path"))


def with_last(nodes: DataFrame) -> DataFrame:
    """Adds ``last_no``, the number of the last node below each, its own if there is none.

    Headings are numbered in reading order, which is the order of a walk, so a node and all below it are a run of numbers
    that ends before the next heading that is no deeper.
    """
    after = Window.partitionBy("document_id").orderBy(F.desc("node_no")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = F.array(*(F.min(F.when(F.col("depth") <= d, F.col("node_no"))).over(after) for d in range(1, MAX_DEPTH + 1)))
    last = F.max("node_no").over(Window.partitionBy("document_id"))
    own = F.coalesce(F.element_at(nexts, F.greatest(F.least("depth", F.lit(MAX_DEPTH)), F.lit(1))) - 1, last)
    return nodes.withColumn("last_no", F.when(F.col("node_id") == ROOT, last).otherwise(own))


def chunks_below(found: DataFrame, nodes: DataFrame, chunks: DataFrame, with_tables: bool = False) -> DataFrame:
    """``found`` (document_id, node_id and more) with chunk_id and path of the chunks of each node and all below it.

    Only documents that have a found node are looked at: their nodes are labelled with runs of numbers, and a chunk meets
    the found nodes of its document whose run holds its own node. ``path`` and tables are as in descendant_chunks.
    """
    few = found.select("document_id").distinct()
    runs = with_last(nodes.join(few, "document_id", "left_semi").select("document_id", "node_id", "node_no", "depth"))
    texts = (chunks if with_tables else chunks.filter("table_id is null")).select("document_id", "node_id", "chunk_id", F.col("chunk_no").alias("path"))
    held = texts.join(runs.select("document_id", "node_id", F.col("node_no").alias("_no")), ["document_id", "node_id"]).drop("node_id")
    met = found.join(runs.select("document_id", "node_id", F.col("node_no").alias("_from"), F.col("last_no").alias("_to")), ["document_id", "node_id"])
    return met.join(held, "document_id").filter(F.col("_no").between(F.col("_from"), F.col("_to"))).drop("_no", "_from", "_to")


@dataclass(frozen=True)
class TreeIndex:
    """Sections to search in. ``places``: (document_id, node_id, node_no, section_number, text), in the order of documents;
    ``grams``: (gram, document_id, node_id, bucket), each run of one to three characters of a section's text, in folders by
    bucket; ``frequencies``: (gram, df), how many sections have it."""

    places: DataFrame
    grams: DataFrame
    frequencies: DataFrame


#: Characters of the longest grams of sections.
GRAM = 3


def places_of(nodes: DataFrame) -> DataFrame:
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    return nodes.filter(F.col("node_id") != ROOT).select("document_id", "node_id", "node_no", "section_number", text.alias("text"))


def grams_of(text: str, lengths: str) -> Column:
    """Distinct runs of characters of each of ``lengths``, an SQL array, in the order of their first places."""
    return F.array_distinct(F.expr(f"flatten(transform({lengths}, n -> if(length({text}) < n, array(), transform(sequence(1, length({text}) - n + 1), k -> substr({text}, k, n)))))"))


def index_tree(nodes: DataFrame) -> TreeIndex:
    """What a search in all documents reads, built once and searched often."""
    places = stored(by_key(places_of(nodes), "document_id"), "places")
    cut = places.select("document_id", "node_id", F.explode(grams_of("text", f"sequence(1, {GRAM})")).alias("gram"))
    grams = stored(in_buckets(cut, "gram", "node_id"), "place-grams", BUCKET)
    return TreeIndex(places, grams, stored(by_key(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram"), "gram-frequencies"))


def search_tree(nodes: DataFrame | TreeIndex, queries: DataFrame, top_k: int) -> DataFrame:
    """Best nodes of each analysed query: (query_id, document_id, node_id, score, rank).

    Ten for a section that the query names, three for each topic and one for each keyword found in title or summary,
    as substrings; repeated keywords count again. ``queries`` has query_id, document_id (null: any), keywords,
    candidate_topics and explicit_section_refs. Ranks are per query and document. With a TreeIndex nothing is built; with
    nodes alone an index is built if a query is about any document.
    """
    places = nodes.places if isinstance(nodes, TreeIndex) else places_of(nodes)
    scope = F.col("document_id") if "document_id" in queries.columns else F.lit(None).cast("string")
    q = queries.select("query_id", scope.alias("of"), "keywords", "candidate_topics", "explicit_section_refs")
    met = places.join(q.filter("of is not null"), F.col("of") == F.col("document_id"))
    free = q.filter("of is null")
    if "document_id" not in queries.columns or not free.isEmpty():
        met = met.unionByName(places_of_words(nodes if isinstance(nodes, TreeIndex) else index_tree(nodes), free))
    score = (
        F.when(F.array_contains("explicit_section_refs", F.col("section_number")), 10.0).otherwise(0.0)
        + 3.0 * F.expr("size(filter(candidate_topics, x -> contains(text, x)))") + F.expr("size(filter(keywords, x -> contains(text, x)))")
    )
    ranked = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "node_no")
    return met.withColumn("score", score).filter("score > 0").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_k).select("query_id", "document_id", "node_id", "score", "rank")


def places_of_words(index: TreeIndex, queries: DataFrame) -> DataFrame:
    """Each query with the places that can score for it in any document: those of a section that it names, or that hold one of its words.

    A word is looked up by the rarest of its three-letter runs; a shorter word is a gram itself. A word with a run that no
    section has is nowhere. Only folders that may hold one of these grams are read, and what they give is looked at whole.
    """
    words = stored(queries.select("query_id", F.explode(F.array_distinct(F.concat("keywords", "candidate_topics"))).alias("word")).filter("word <> ''"), "words")
    parts = words.select("word").distinct().select("word", F.explode(grams_of("word", f"array(least({GRAM}, length(word)))")).alias("gram"))
    known = parts.join(index.frequencies, "gram", "left").groupBy("word")
    anchors = known.agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.bool_and(F.col("df").isNotNull()).alias("every")).filter("every").drop("every")
    anchors = stored(anchors, "anchors")
    found = of_keys(index.grams, "gram", anchors).join(sized(anchors), "gram").select("word", "document_id", "node_id")
    holds = found.join(index.places.select("document_id", "node_id", "text"), ["document_id", "node_id"]).filter(F.contains("text", F.col("word"))).select("word", "document_id", "node_id")
    by_word = words.join(holds, "word").select("query_id", "document_id", "node_id")
    named = queries.select("query_id", F.explode("explicit_section_refs").alias("section_number")).join(index.places.select("document_id", "node_id", "section_number"), "section_number")
    pairs = by_word.unionByName(named.select("query_id", "document_id", "node_id")).distinct()
    return index.places.join(pairs, ["document_id", "node_id"]).join(queries, "query_id").select(*index.places.columns, *queries.columns)
