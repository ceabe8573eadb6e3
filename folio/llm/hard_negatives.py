"""Hard negatives by a vector-approximation file.

Each dimension's range is cut into cells of one width, and a vector is approximated by its cells, a byte a dimension.
For an anchor, a table of 256 entries a dimension holds the largest product that a component in each cell can have with
the anchor's; the sum of 64 lookups bounds the score of a row from above, and as all cells of a dimension are as wide, the
sum less a constant of the anchor bounds it from below. Only rows whose bounds let them enter a window are scored exactly.

Anchors meet rows in blocks: a block of anchors and a block of rows share a key, so a task holds one of each, and only the
best rows of a block leave it. No side is broadcast or collected. The work is anchors times rows, as the task has it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.llm.common import removed, scratch, written

#: Cells a dimension: what a byte can tell apart.
CELLS = 256
#: Components below this size have products that sum to less than 2**63 over 64 dimensions.
LARGEST = 1 << 28
#: How a component becomes an integer.
SCALE = 256


@dataclass(frozen=True)
class Mining:
    """``positives`` best rows of an anchor's label, then for each the ``negatives`` best rows of other labels whose score
    is from ``least`` to ``most`` per cent of the positive's. Blocks bound what a task holds; they change no result."""

    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90
    rows_a_block: int = 65_536
    anchors_a_block: int = 1_024


def integer_vectors(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label and ``q``, the components as floor(256 * x) in double precision.

    Rows with a null id, label or vector, an empty vector, a null, NaN or infinite component, or one of 2**20 or more in
    size (its products would not fit) are left out. Repeated rows repeat; an empty table stays empty; other columns are
    left behind.
    """
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < LARGEST)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
    # NaN compares as the largest of all numbers, so it fails as infinity does
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False))))
    # guarded, since a filter on q may be worked out before those above
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.when(fine(x), F.floor(x.cast("double") * SCALE)).cast("int")).alias("q"))


@dataclass(frozen=True)
class Cells:
    """Where the cells of each dimension begin, and how wide they are: integers from ``low + c * width`` on, ``width`` of them."""

    low: np.ndarray
    width: np.ndarray

    def of(self, q: np.ndarray) -> np.ndarray:
        return ((q - self.low) // self.width).astype(np.uint8)

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, int]:
        """The largest product a component in each cell can have with the anchor's, and how far below the sum of these the score can be."""
        first = self.low[:, None] + np.arange(CELLS)[None, :] * self.width[:, None]
        last = first + (self.width - 1)[:, None]
        most = np.maximum(first * anchor[:, None], last * anchor[:, None])
        return most, int((np.abs(anchor) * (self.width - 1)).sum())


def cells_of(vectors: DataFrame) -> Cells:
    """The range of each dimension over all vectors in ``CELLS`` cells; a row for each dimension comes to the driver."""
    ranges = vectors.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    low = np.array([r.low for r in ranges], np.int64)
    # shorter vectors are filled up with zeros
    low, high = np.minimum(low, 0), np.maximum(np.array([r.high for r in ranges], np.int64), 0)
    return Cells(low, (high - low) // CELLS + 1)


def approximated(cells: Cells):
    """A function over Arrow batches that adds the approximation; vectors are filled up to one length."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            q = matrix(batch.column("q"), len(cells.low))
            flat = np.ascontiguousarray(cells.of(q))
            names = ["vec_id", "label", "anchor", "cells", "exact"]
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("anchor"), binary(flat), binary(q.astype("<i4"))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def matrix(lists, size: int) -> np.ndarray:
    """An Arrow list column as rows of ``size`` integers."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), size), np.int64)
    out[np.arange(size)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def binary(rows: np.ndarray):
    """Rows of an array as an Arrow column of bytes."""
    import pyarrow as pa

    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def unpacked(column, kind: str, size: int) -> np.ndarray:
    """An Arrow column of bytes as rows of ``size`` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


class Block:
    """A block of rows, ready to be bounded and scored against one anchor after the other."""

    def __init__(self, rows, cells: Cells) -> None:
        size = len(cells.low)
        self.cells = cells
        self.ids = rows["vec_id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        # by dimension, so that each lookup reads and writes in a row
        self.places = np.ascontiguousarray(unpacked(rows["cells"], np.uint8, size).T)
        self.exact = unpacked(rows["exact"], "<i4", size)
        self.upper, self.step = np.empty(len(self.ids), np.int64), np.empty(len(self.ids), np.int64)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, int]:
        """Upper bounds of all rows' scores, and how far below them the lower bounds are."""
        most, spread = self.cells.tables(anchor)
        self.upper[:] = 0
        for d, places in enumerate(self.places):
            np.take(most[d], places, out=self.step, mode="clip")
            self.upper += self.step
        return self.upper, spread

    def scores(self, chosen: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.exact[chosen].astype(np.int64) @ anchor

    def best(self, possible: np.ndarray, lower: np.ndarray, upper: np.ndarray, most: int, anchor: np.ndarray, least: int, greatest: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` best of the ``possible`` rows whose scores are from ``least`` to ``greatest``, ties by id: places and scores.

        Rows that surely score in the window bound what can be among its best from below.
        """
        sure = lower[possible & (lower >= least) & (upper <= greatest)]
        floor = np.partition(sure, -most)[-most] if len(sure) >= most else least
        chosen = np.flatnonzero(possible & (lower <= greatest) & (upper >= floor))
        score = self.scores(chosen, anchor)
        inside = (score >= least) & (score <= greatest)
        chosen, score = chosen[inside], score[inside]
        order = np.lexsort((self.ids[chosen], -score))[:most]
        return chosen[order], score[order]


#: Beyond any score.
FAR = np.iinfo(np.int64).max


def nearest(cells: Cells, mining: Mining):
    """Of a block of anchors and one of rows: each anchor's best rows of its own label."""
    import pyarrow as pa

    def run(anchors, rows):
        out = []
        if anchors.num_rows and rows.num_rows:
            block = Block(rows, cells)
            for vec, anchor, label, exact in zip(anchors["anchor_vec_id"].to_pylist(), anchors["number"].to_pylist(), anchors["anchor_label"].to_pylist(), unpacked(anchors["anchor_exact"], "<i4", len(cells.low))):
                a = exact.astype(np.int64)
                upper, spread = block.bounds(a)
                possible = (block.labels == label) & (block.ids != vec)
                places, scores = block.best(possible, upper - spread, upper, mining.positives, a, -FAR, FAR)
                out += ((anchor, i, s) for i, s in zip(block.ids[places].tolist(), scores.tolist()))
        anchor, ids, scores = zip(*out) if out else ((), (), ())
        return pa.table({"anchor": pa.array(anchor, pa.int64()), "positive_id": pa.array(ids, pa.int64()), "positive_score": pa.array(scores, pa.int64())})

    return run


def hardest(cells: Cells, mining: Mining):
    """Of a block of anchors, each with its positives, and one of rows: for each positive the best rows of its window."""
    import pyarrow as pa

    def run(anchors, rows):
        out = []
        if anchors.num_rows and rows.num_rows:
            block = Block(rows, cells)
            for anchor, label, exact, found in zip(anchors["number"].to_pylist(), anchors["anchor_label"].to_pylist(), unpacked(anchors["anchor_exact"], "<i4", len(cells.low)), anchors["found"].to_pylist()):
                a = exact.astype(np.int64)
                upper, spread = block.bounds(a)
                lower, possible = upper - spread, block.labels != label
                for positive in found:
                    least, greatest = -(-mining.least * positive["positive_score"] // 100), mining.most * positive["positive_score"] // 100
                    if least <= greatest:
                        places, scores = block.best(possible, lower, upper, mining.negatives, a, least, greatest)
                        out += ((anchor, positive["slot"], i, s) for i, s in zip(block.ids[places].tolist(), scores.tolist()))
        anchor, slots, ids, scores = zip(*out) if out else ((), (), (), ())
        return pa.table({"anchor": pa.array(anchor, pa.int64()), "slot": pa.array(slots, pa.int32()), "negative_id": pa.array(ids, pa.int64()), "negative_score": pa.array(scores, pa.int64())})

    return run


def first(df: DataFrame, by: list[str], score: str, tie: str, name: str, most: int) -> DataFrame:
    """The ``most`` best rows of each group, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= most)


def mine_negatives(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for ``vectors`` of ``integer_vectors``.

    Higher inner products come first, ties by smaller id. Positives are rows of the anchor's label under another id,
    negatives rows of other labels. Repeated rows count as rows: as anchors they repeat their results, as positives they
    take places of their own, each with its negatives, and as negatives they take ranks of their own. A vector that is
    shorter than others counts as filled up with zeros. An anchor without positives, and a positive that scores under
    zero, have no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    folder = scratch(spark, "negatives")
    kinds = vectors.select("vec_id", "label", "q", F.coalesce(is_anchor, F.lit(False)).alias("_is"))
    counts = kinds.agg(F.count("*").alias("rows"), F.count(F.when(F.col("_is"), 1)).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not counts.anchors:
        return spark.createDataFrame([], schema)
    cells = cells_of(vectors)
    # an anchor's own number, since ids may repeat; it only has to stay as it is once the file is written
    numbered = kinds.withColumn("anchor", F.when(F.col("_is"), F.monotonically_increasing_id())).drop("_is")
    kind = vectors.schema["label"].dataType.simpleString()
    file = written(numbered.mapInArrow(approximated(cells), f"vec_id long, label {kind}, anchor long, cells binary, exact binary"), f"{folder}/file")
    # small tables still give each core a few blocks of a thousand rows or more
    n_rows = max(-(-counts.rows // mining.rows_a_block), min(4 * spark.sparkContext.defaultParallelism, -(-counts.rows // 1024)))
    n_anchors = -(-counts.anchors // mining.anchors_a_block)
    blocks = file.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).withColumn("r", F.pmod(F.monotonically_increasing_id(), F.lit(n_rows)).cast("int")).drop("anchor")
    own = [F.col(c).alias(f"anchor_{c}") for c in ("vec_id", "label", "exact")]
    anchors = file.filter(F.col("anchor").isNotNull()).select(F.col("anchor").alias("number"), F.pmod(F.xxhash64("anchor"), F.lit(n_anchors)).cast("int").alias("at"), *own)

    def met(left: DataFrame, step, result: str) -> DataFrame:
        spread = left.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        return spread.groupBy("at", "to").cogroup(blocks.groupBy("a", "r")).applyInArrow(step, result)

    near = met(anchors, nearest(cells, mining), "anchor long, positive_id long, positive_score long")
    positives = written(first(near, ["anchor"], "positive_score", "positive_id", "slot", mining.positives), f"{folder}/positives")
    found = positives.groupBy("anchor").agg(F.collect_list(F.struct("slot", "positive_score")).alias("found"))  # five at most
    hard = met(anchors.join(found, F.col("number") == F.col("anchor")), hardest(cells, mining), "anchor long, slot int, negative_id long, negative_score long")
    best = written(first(hard, ["anchor", "slot"], "negative_score", "negative_id", "rank", mining.negatives), f"{folder}/negatives")
    names = file.filter(F.col("anchor").isNotNull()).select("anchor", F.col("vec_id").alias("anchor_id"))
    out = best.join(positives, ["anchor", "slot"]).join(names, "anchor")
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])
