"""Exact n-gram Jaccard join by vertical partitioning, and the connected components of its links.

Shingles are 64-bit hashes of a few words; the global order of shingles is by their hash, with frequent shingles last.

1. Documents with one shingle set are one node. A node keeps only its ``head``, the lowest hashes of its set.
2. Shingles in many heads are frequent; they go last in the order, the more frequent the later. A node's prefix is the
   first of its shingles in the global order, so many that two linked nodes must share one (prefix filter). Nodes whose
   head holds too few rare shingles read their text again.
3. Nodes that share a prefix shingle form a bucket. Components need not compare all pairs of a bucket: first each node
   meets the bucket's center, the node with the fewest shingles of its own, then the best node of another component
   there, and at last only nodes that are still in different components and long enough for a link from there on. In
   a crowded bucket these meet block by block, among nodes of like size.
4. A pair is decided by partial overlaps: the order is cut into fragments, each node's set is cut the same way, the
   overlaps of a pair's fragments are counted apart and summed. The first fragment comes alone: a pair whose overlap
   there leaves too little to reach, however the others turn out, is dropped before those are read.
5. Components grow by hooking to the least neighbour and pointer jumping, with a written table after each round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import few, removed, scratch, sized, small_batches, written

#: A-Z to a-z, and what is white space, by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd base for word hashes and its inverse, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 18
#: Rows of a batch that are worked on at once.
SLICE_ROWS = 512


@dataclass(frozen=True)
class Jaccard:
    """Linked: 100 * shared >= percent * union. ``frequent``: nodes that may share a shingle before it goes last in the order.
    ``crowd``: rows of a bucket beyond which its nodes are compared block by block; ``block``, ``block_shingles``: about how
    many nodes and shingles one holds, or one node."""

    percent: int = 85
    words: int = 4
    frequent: int = 48
    fragments: int = 5
    crowd: int = 128
    block: int = 1024
    block_shingles: int = 1_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.array([0xD6E8FEB86659FD93], np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.array([0xD6E8FEB86659FD93], np.uint64)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Shingle sets of many texts at once, as arrays; the tables of powers grow with the longest text."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.powers = self.inverses = np.ones(1, np.uint64)

    def word_hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of the texts in ``data``, and the number of each text's first word."""
        if len(self.powers) <= len(data):
            n = len(data) + 1
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table))
        inside = ~SPACE[data]
        border = np.zeros(len(data) + 1, np.bool_)
        border[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~border[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~border[1:]
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])])
        h = (sums[last + 1] - sums[first]) * self.inverses[first]
        return mixed(h ^ (last - first + 1).astype(np.uint64)), np.searchsorted(first, offsets)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        h, at = self.word_hashes(data, offsets)
        n = self.size
        whole = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            whole = mixed(whole * np.array([BASE], np.uint64) + h[k : k + len(whole)])
        whole = whole.view(np.int64)
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
            if end - begin >= n:
                s = np.sort(whole[begin : end - n + 1])
            elif end > begin:  # fewer words than a shingle: they are one, told from longer ones by their number
                short = np.full(1, end - begin, np.uint64)
                for x in h[begin:end]:
                    short = mixed(short * np.array([BASE], np.uint64) + x)
                s = short.view(np.int64)
            else:
                s = whole[:0]
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s

    def sets(self, texts: pa.BinaryArray) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text, in blocks of bounded size, or one text."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, side="right")) - 1)
            yield from self.block(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
            begin = end


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    lengths = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def signature_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    """How many of the first shingles of a set of ``n`` two linked sets cannot both miss."""
    return n - (percent * n + 99) // 100 + 1


def head_length(n: int, percent: int) -> int:
    return min(n, 2 * prefix_length(n, percent) + 16)


def as_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def heads_of(docs: DataFrame, j: Jaccard) -> DataFrame:
    """doc_id, n (size of its set), signature of the set, and head."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(j.words)
        for batch in sliced(batches):
            sizes, signatures, found = [], [], []
            for s in shingler.sets(batch.column(1)):
                sizes.append(len(s))
                signatures.append(signature_of(s))
                found.append(s[: head_length(len(s), j.percent)])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), listed(found)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "signature", "head"])

    return as_bytes(docs).mapInArrow(rows, "doc_id long, n long, signature binary, head array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, j: Jaccard, parts: list[int] | None) -> DataFrame:
    """(node, part, shingles) of the wanted nodes' sets: the fragments in ``parts``, cut at fixed borders of the order, or None for whole sets.

    ``wanted``, a written table of (node, signature), is broadcast if small; else texts are dealt by id to meet it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(j.words)
        borders = (np.arange(1, j.fragments, dtype=np.float64) / j.fragments * 2.0**64 - 2.0**63).astype(np.int64)
        for batch in sliced(batches):
            nodes, numbers, found = [], [], []
            for node, signature, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingler.sets(batch.column(1))):
                if signature_of(s) == signature:
                    for k, part in enumerate([s] if parts is None else np.split(s, np.searchsorted(s, borders))):
                        if len(part) and (parts is None or k in parts):
                            nodes.append(node)
                            numbers.append(k)
                            found.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), listed(found)], names=["node", "part", "shingles"])

    texts = as_bytes(docs).withColumnRenamed("doc_id", "node").join(sized(wanted.select("node", "signature")), "node")
    return texts.select("node", "text", "signature").mapInArrow(rows, "node long, part int, shingles array<long>")


def prefixes_of(nodes: DataFrame, column: str, frequent: DataFrame, j: Jaccard) -> DataFrame:
    """(node, n, prefix) from arrays of a node's lowest shingles; prefix is null where too few of them are rare and more exist.

    Rare shingles come in the order of their hashes, then frequent ones by tier and hash.
    """
    if few(frequent):
        last = sent(frequent)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, tiers = last.value
            for batch in sliced(batches):
                values = batch.column(2)
                flat, at = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy() - values.offsets[0].as_py()
                slot = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                usual = common[slot] == flat if len(common) else np.zeros(len(flat), np.bool_)
                found, known = [], []
                for n, begin, end in zip(batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    s, u = flat[begin:end], usual[begin:end]
                    p = prefix_length(n, j.percent)
                    rare = s[~u]
                    known.append(len(s) == n or len(rare) >= p)
                    if known[-1] and len(rare) < p:
                        rare = np.concatenate([rare, s[u][np.lexsort((s[u], tiers[slot[begin:end][u]]))]])
                    found.append(rare[:p] if known[-1] else s[:0])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known), listed(found)], names=["node", "n", "known", "prefix"])

        out = nodes.select("node", "n", column).mapInArrow(rows, "node long, n long, known boolean, prefix array<long>")
        return out.select("node", "n", F.when(F.col("known"), F.col("prefix")).alias("prefix"))
    hit = nodes.select("node", F.explode(column).alias("shingle")).join(frequent, "shingle").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("tier", "shingle"))).alias("tiered"))
    none = F.array().cast("array<bigint>")
    told = nodes.join(hit, "node", "left").withColumn("last", F.coalesce(F.col("tiered.shingle"), none)).withColumn("rare", F.array_except(column, "last"))
    p = F.expr(f"cast(n - floor(({j.percent} * n + 99) / 100) + 1 as int)")
    return told.select("node", "n", F.when((F.size(column) == F.col("n")) | (F.size("rare") >= p), F.slice(F.concat("rare", "last"), F.lit(1), p)).alias("prefix"))


def sent(frequent: DataFrame) -> Broadcast:
    """The frequent shingles, sorted, and their tiers, on every executor; their number was checked."""
    rows = frequent.select("shingle", "tier").toArrow()
    found, tiers = (rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(2))
    order = np.argsort(found)
    return frequent.sparkSession.sparkContext.broadcast((found[order].astype(np.int64), tiers[order].astype(np.int8)))


class Components:
    """Component labels of nodes that have links, on written tables; a node without a row is its own component."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.round = spark, folder, 0
        self.labels: DataFrame | None = None

    def label(self, df: DataFrame, node: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(node))
        l = self.labels.select(F.col("node").alias(f"_{out}"), F.col("component").alias(f"_{out}_c"))  # noqa: E741
        return df.join(l, F.col(node) == F.col(f"_{out}"), "left").withColumn(out, F.coalesce(f"_{out}_c", node)).drop(f"_{out}", f"_{out}_c")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.round += 1
        return written(df, f"{self.folder}/{name}-{self.round}")

    def join(self, links: DataFrame) -> bool:
        """Merges the components of linked nodes; whether any were merged."""
        edges = self.label(self.label(links, "a", "ca"), "b", "cb").filter("ca <> cb")
        edges = self.save(edges.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return False
        tree = None
        while True:
            # alternating stars: hook every node and its larger neighbours to the least neighbour, then shorten
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
            up = large  # a < b: each larger node points at smaller ones
            low = up.groupBy("b").agg(F.min("a").alias("m"))
            small = up.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b").unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
            new = self.save(small, "edges")
            # a forest of stars: every node on the right appears once, and none of them on the left
            crowded = new.groupBy("b").count().filter("count > 1").select(F.lit(1).alias("x")).limit(1)
            chained = new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").select(F.lit(1).alias("x")).limit(1)
            edges = new
            if crowded.unionByName(chained).isEmpty():
                tree = new
                break
        roots = tree.select(F.col("b").alias("old"), F.col("a").alias("new"))
        if self.labels is None:
            labels = roots.select(F.col("old").alias("node"), F.col("new").alias("component"))
        else:
            # a giant component's rows share one key: a small table of roots is broadcast to them
            roots = written(roots, f"{self.folder}/roots-{self.round}")
            moved = self.labels.join(sized(roots), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
            fresh = roots.join(self.labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
            labels = moved.unionByName(fresh)
        self.labels = self.save(labels, "labels")
        return True


def block_links(percent: int, fragment: int = 2_048):
    """A function over the nodes of two blocks of a bucket: links between different components, enough to join all that are linked.

    The blocks' shared shingles are cut into fragments; each gives partial overlaps of all pairs by one product of
    incidence matrices, and these are summed. Only links leave the task, at most one less than there are nodes.
    Two nodes with one ``met`` have met in that bucket, an earlier one than this, and are left out here.
    """

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        low, high, bucket = rows["i"].iloc[0], rows["j"].iloc[0], rows["shingle"].iloc[0]
        rows = rows.drop_duplicates("node").sort_values("node")
        sizes = rows["shingles"].map(len).to_numpy()
        flat = np.concatenate(rows["shingles"].to_list())
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.cumsum(count > 1) - 1
        keep = count[code] > 1
        owner, code = owner[keep], order[code[keep]]
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        both = np.zeros((len(left), len(right)), np.float32)
        by_code = np.argsort(code, kind="stable")
        owner, code = owner[by_code], code[by_code]
        for begin in range(0, int(code[-1]) + 1 if len(code) else 0, fragment):
            a, b = np.searchsorted(code, [begin, begin + fragment])
            held = np.zeros((len(rows), fragment), np.float32)
            held[owner[a:b], code[a:b] - begin] = 1
            both += held[left] @ held[right].T
        n, node, component, met = (rows[c].to_numpy() for c in ("n", "node", "component", "met"))
        linked = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (component[left][:, None] != component[right][None, :])
        linked &= (met[left][:, None] != met[right][None, :]) | (met[left] == bucket)[:, None]
        group = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        out = []
        for k in np.flatnonzero(linked.any(1)).tolist():
            hits = right[linked[k]]
            _, first = np.unique(component[hits], return_index=True)
            for h in hits[first].tolist():
                x, y = root(int(component[left[k]])), root(int(component[h]))
                if x != y:
                    group[max(x, y)] = min(x, y)
                    out.append((min(node[left[k]], node[h]), max(node[left[k]], node[h])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return found


def crowd_links(docs: DataFrame, rows: DataFrame, names: DataFrame, j: Jaccard, folder: str) -> DataFrame:
    """Links between components among the nodes of crowded buckets (shingle, node, n, pos, component).

    Only nodes of one bucket meet, and only those of like size: sizes are cut into bands such that linked nodes lie in
    one band or in neighbouring ones. A band is dealt into blocks of bounded size, and each pair of blocks is a task of
    its own. A bucket whose nodes have all met in another that comes before it in the order is left out.
    """
    first = rows.groupBy("node").agg(F.min_by("shingle", "pos").alias("met"))
    known = written(rows.join(first, "node"), f"{folder}/crowd-rows")
    needed = known.groupBy("shingle").agg(F.min("met").alias("lo"), F.max("met").alias("hi")).filter("lo <> hi or lo = shingle").select("shingle")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / j.percent) * (1 + 1e-9))).cast("int") if j.percent < 100 else F.col("n").cast("int")
    nodes = written(known.join(needed, "shingle").withColumn("band", band), f"{folder}/crowd-nodes")
    share = F.greatest(F.count(F.lit(1)) / j.block, F.sum("n") / j.block_shingles)
    blocks = written(nodes.groupBy("shingle", "band").agg(F.ceil(share).cast("int").alias("blocks")), f"{folder}/crowd-blocks")
    above = blocks.select("shingle", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("shingle", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    around = blocks.join(above, ["shingle", "band"], "left").join(below, ["shingle", "band"], "left").na.fill(0, ["above", "below"])
    dealt = nodes.join(sized(written(around, f"{folder}/crowd-around")), ["shingle", "band"]).withColumn("block", F.expr("band * 1000000000L + pmod(xxhash64(node), blocks)"))
    # a node goes to every pair of blocks that its own is in: with each of its band, and of the bands beside it
    others = F.expr(
        "concat(transform(sequence(0, blocks - 1), k -> band * 1000000000L + k),"
        " if(above > 0, transform(sequence(0, above - 1), k -> (band + 1) * 1000000000L + k), array()),"
        " if(below > 0, transform(sequence(0, below - 1), k -> (band - 1) * 1000000000L + k), array()))"
    )
    keyed = dealt.select("shingle", "node", "n", "component", "met", "block", F.explode(others).alias("other"))
    keyed = keyed.select("shingle", "node", "n", "component", "met", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wanted = written(names.join(nodes.select("node").distinct(), "node", "left_semi"), f"{folder}/crowd-wanted")
    sets = written(sets_of(docs, wanted, j, None), f"{folder}/crowd-sets")
    met = keyed.join(sets.select("node", "shingles"), "node").groupBy("shingle", "i", "j").applyInPandas(block_links(j.percent), "a long, b long")
    links = written(met.distinct(), f"{folder}/crowd-links")
    removed(docs.sparkSession, f"{folder}/crowd-sets")
    return links


def jaccard_components(docs: DataFrame, j: Jaccard = Jaccard(), links_out: list[DataFrame] | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach).

    A null or empty text, or one without words, has no shingles and stands alone. Repeated rows each get a row of the
    result. A doc_id stands for one text: where rows give it several, it is compared by the set whose signature is
    least. A row without a doc_id is linked with nothing and its component is null.
    An empty table gives an empty result; columns beside doc_id and text are ignored. No pair is lost to any cap:
    frequent shingles only move to the end of the order. ``links_out`` gets the tables of verified links between nodes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "set-join")

    # 1. one node a distinct set, named by the least doc_id
    rows = written(heads_of(docs, j), f"{folder}/rows")
    classes = written(rows.filter("n > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("node")), f"{folder}/classes")
    names = written(classes.groupBy("node").agg(F.min("signature").alias("signature")), f"{folder}/names")
    joined = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("signature")).alias("of")).join(classes, F.col("of") == F.col("signature"), "left")
    members = written(joined.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), f"{folder}/members")
    owners = sized(names.select("node", F.col("signature").alias("own")))
    heads = rows.join(owners, (F.col("doc_id") == F.col("node")) & (F.col("signature") == F.col("own")))
    nodes = written(heads.select("node", "n", "head"), f"{folder}/nodes")
    removed(spark, f"{folder}/rows")

    # 2. prefixes in the global order
    counted = nodes.select(F.explode("head").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"))
    frequent = written(counted.filter(F.col("c") > j.frequent).select("shingle", F.floor(F.log2("c")).cast("int").alias("tier")), f"{folder}/frequent")
    told = written(prefixes_of(nodes, "head", frequent, j), f"{folder}/told")
    removed(spark, f"{folder}/nodes")
    again = written(names.join(sized(told.filter("prefix is null").select("node")), "node", "left_semi"), f"{folder}/again")
    # a table between two steps in Python, so that a task has one worker
    whole = written(sets_of(docs, again, j, None).select("node", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("whole")), f"{folder}/whole")
    late = written(prefixes_of(whole, "whole", frequent, j), f"{folder}/late")
    entries = told.filter("prefix is not null").unionByName(late).select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    # of a bucket, the node that has the fewest shingles before this one is likeliest to be what the others are copies of
    center = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "node", "n", "pos")).alias("center")
    shared = written(entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), center).filter("c > 1").select("shingle", "center"), f"{folder}/shared")
    # a repeated row is no second node
    entries = written(entries.join(sized(shared), "shingle").dropDuplicates(["shingle", "node"]), f"{folder}/entries")
    removed(spark, f"{folder}/told")
    removed(spark, f"{folder}/whole")

    # 3. rounds of candidate pairs
    components = Components(spark, folder)
    # What two sets share is at most what either has from their first common shingle on. A pair is looked at in every
    # bucket it shares; where the bucket's shingle is the first common one this bound holds, elsewhere nothing is lost.
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    possible = 100 * most >= j.percent * (F.col("na") + F.col("nb") - most)

    def pairs_with(rows: DataFrame, center: str) -> DataFrame:
        c = F.col(center)
        sides = rows.filter(F.col("node") != c["node"]).select("node", "n", F.col("n").alias("na"), F.col("pos").alias("pa"), c["node"].alias("cn"), c["n"].alias("nb"), c["pos"].alias("pb")).filter(possible)
        first = F.col("node") < F.col("cn")
        return sides.select(
            F.least("node", "cn").alias("a"), F.greatest("node", "cn").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")
        ).distinct()

    enough = f"100 * both >= {j.percent} * (na + nb - both)"

    def overlaps(pairs: DataFrame, parts: list[int], name: str) -> DataFrame:
        """``pairs`` with ``part``, overlap and sizes of each of the given fragments that both sets have shingles in."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(names.join(ends, "node", "left_semi"), f"{folder}/wanted-{name}")
        sets = written(sets_of(docs, wanted, j, parts), f"{folder}/sets-{name}")
        keyed = pairs.select("*", F.explode(F.array(*map(F.lit, parts))).alias("part"))
        left = sets.select(F.col("node").alias("a"), "part", F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), "part", F.col("shingles").alias("sb"))
        met = keyed.join(left, ["a", "part"], "left").join(right, ["b", "part"], "left")
        size = lambda c: F.coalesce(F.size(c), F.lit(0))
        # rows repeated in the input repeat here
        return met.groupBy("a", "b", "na", "nb", "part").agg(
            F.max(size(F.array_intersect("sa", "sb"))).alias("both"), F.max(size("sa")).alias("ha"), F.max(size("sb")).alias("hb"),
        )

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones: the first fragment's overlap and what the others could add at most rule out most pairs."""
        pairs = written(pairs, f"{folder}/pairs-{name}")
        first = overlaps(pairs, [0], f"{name}-0")
        bound = F.col("both") + F.least(F.col("na") - F.col("ha"), F.col("nb") - F.col("hb"))
        likely = first.filter(100 * bound >= j.percent * (F.col("na") + F.col("nb") - bound)).select("a", "b", "na", "nb", F.col("both").alias("begun"))
        likely = written(likely, f"{folder}/likely-{name}")
        removed(spark, f"{folder}/sets-{name}-0")
        rest = overlaps(likely.drop("begun"), [*range(1, j.fragments)], f"{name}-1").groupBy("a", "b").agg(F.sum("both").alias("later"))
        links = written(likely.join(rest, ["a", "b"]).withColumn("both", F.col("begun") + F.col("later")).filter(enough).select("a", "b"), f"{folder}/links-{name}")
        removed(spark, f"{folder}/sets-{name}-1")
        if links_out is not None:
            links_out.append(links)
        return links

    components.join(verified(pairs_with(entries, "center"), "first"))

    # buckets that hold several components still: meet the best node outside the component of the bucket's center
    labelled = components.label(entries, "node", "component")
    several = labelled.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle")
    open_rows = components.save(labelled.join(several, "shingle"), "open")
    base = components.label(open_rows.select("shingle", F.col("center.node").alias("least")).distinct(), "least", "base").drop("least")
    best = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "node", "n", "pos")).alias("rival")
    rival = open_rows.join(base, "shingle").filter("component <> base").groupBy("shingle").agg(best)
    components.join(verified(pairs_with(open_rows.join(rival, "shingle"), "rival"), "second"))

    # What is left: nodes of different components that share a prefix shingle. A node is weak in a bucket if it has too
    # little from there on to link with a set of its own size; it can then only link with a smaller set. Of two weak
    # nodes each would have to be the smaller, so they never meet.
    labelled = components.label(open_rows.select("shingle", "node", "n", "pos"), "node", "component")
    several = labelled.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle")
    strong = 100 * (F.col("n") - F.col("pos")) >= j.percent * (F.col("n") + F.col("pos"))
    rest = components.save(labelled.join(several, "shingle").withColumn("strong", strong), "rest")
    size = rest.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.max("strong").alias("any"))
    crowded = written(size.filter((F.col("c") > j.crowd) & F.col("any")).select("shingle"), f"{folder}/crowded")
    crowds = rest.join(sized(crowded), "shingle", "left_semi")
    rest = rest.join(sized(crowded), "shingle", "left_anti")
    x = rest.filter("strong").select("shingle", F.col("node").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
    y = rest.select("shingle", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"), F.col("strong").alias("too"))
    met = x.join(y, "shingle").filter("ca <> cb and x <> y and (not too or x < y)").filter(possible)
    first = F.col("x") < F.col("y")
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
    components.join(verified(met, "third"))
    if not crowded.isEmpty():
        components.join(crowd_links(docs, crowds, names, j, folder))

    out = components.label(members, "node", "component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
