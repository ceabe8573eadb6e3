"""Exact inner-product search that leaves out cells of vectors which cannot hold a result.

Vectors lie in folders by their nearest center. No vector of a cell can score more than the center's score and the query's
length times the cell's radius, by the triangle inequality. A query looks first into its most promising cells; the k-th
score there is a floor, and only cells that may reach it are looked into after that. The result is that of a full search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.dense import blocks
from folio.sources.scratch import stored

#: Cells at most, vectors a cell that centers are made of, rounds in which they move, and parts that a crowded cell is dealt to.
MOST_CELLS, SAMPLE_A_CELL, ROUNDS, PARTS = 256, 64, 8, 16
#: What scores may differ by when they are rounded.
SLACK = 1e-5


@dataclass(frozen=True)
class CellIndex:
    """``vectors``: (id, vec, cell), in folders by cell; the rest, of a row a cell, is on the driver: centers, radii, sizes."""

    vectors: DataFrame
    centers: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def centers_of(rows: np.ndarray, k: int) -> np.ndarray:
    """``k`` centers of a sample by Lloyd's rounds, from rows spread over it; a center that loses its rows stays where it is."""
    centers = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest(rows, centers)[0]
        for c in range(k):
            own = rows[near == c]
            if len(own):
                centers[c] = own.mean(axis=0)
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row, and how far it is."""
    squares = (centers**2).sum(axis=1) - 2 * rows @ centers.T
    near = squares.argmin(axis=1)
    return near, np.linalg.norm(rows - centers[near], axis=1)


def index_cells(vectors: DataFrame) -> CellIndex:
    """Cells over all of ``vectors`` (id, vec); centers are made of a bounded sample, the rows whose ids have the least hashes.

    Rows with a null vector are left out. Radii are of all rows of a cell, so that a poor sample costs time, not results.
    """
    rows = vectors.filter(F.col("vec").isNotNull()).select("id", "vec")
    n = rows.count()
    k = max(1, min(MOST_CELLS, round(math.sqrt(n) / 2)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(k * SAMPLE_A_CELL).toPandas()
    if not n:
        return CellIndex(stored(rows.withColumn("cell", F.lit(0)), "cells", "cell"), np.zeros((1, 1)), np.zeros(1), np.zeros(1, int))
    centers = centers_of(np.stack(sample["vec"].to_numpy()).astype(np.float64), k)
    sent = vectors.sparkSession.sparkContext.broadcast(centers)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, far = nearest(np.stack(batch["vec"].to_numpy()).astype(np.float64), sent.value)
                yield batch.assign(cell=cell, far=far)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    dealt = rows.mapInPandas(placed, f"id {kinds['id']}, vec {kinds['vec']}, cell int, far double").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    cells = stored(dealt, "cells", "cell")
    radii, sizes = np.zeros(k), np.zeros(k, int)
    for r in cells.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        radii[r.cell], sizes[r.cell] = r.radius, r.n
    return CellIndex(cells.drop("far"), centers, radii, sizes)


def search_cells(index: CellIndex, queries: DataFrame, top_k: int, block_bytes: int = 16 << 20, digits: int = 6) -> tuple[DataFrame, float]:
    """(query_id, id, score, rank) as of ``vector_search``, and the share of all pairs of query and vector that were scored.

    Queries come to the driver in blocks of bounded size; each block has two passes over the cells that it needs.
    """
    spark, kind, q_kind = index.vectors.sparkSession, index.vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_kind}, id {kind}, score double"
    parts, scored, pairs = [], 0, 0
    for names, matrix in blocks(queries, block_bytes) if index.sizes.any() else ():
        bound = matrix @ index.centers.T + np.linalg.norm(matrix, axis=1)[:, None] * index.radii[None, :] + SLACK
        bound[:, index.sizes == 0] = -np.inf
        order = np.argsort(-bound, axis=1)
        # as many of the best cells as hold enough vectors
        seen = np.cumsum(index.sizes[order], axis=1) - index.sizes[order] < 4 * top_k
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order, seen, axis=1)
        first &= bound > -np.inf
        found = stored(best_in(index, names, matrix, first, top_k, digits, schema), "first-cells")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        kth = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == top_k).select("query_id", "score").collect()  # a row a query of the block
        floors = {r.query_id: r.score for r in kth}
        floor = np.array([floors.get(name, -np.inf) for name in names.tolist()])
        rest = (bound >= floor[:, None] - SLACK) & ~first & (index.sizes > 0)[None, :]
        parts += [found, best_in(index, names, matrix, rest, top_k, digits, schema)]
        scored += int(((first | rest) * index.sizes[None, :]).sum())
        pairs += len(names) * int(index.sizes.sum())
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top_k), scored / max(1, pairs)


def best_in(index: CellIndex, names: np.ndarray, matrix: np.ndarray, wanted: np.ndarray, top_k: int, digits: int, schema: str) -> DataFrame:
    """Each task's best of each query, of the cells that ``wanted``, a row a query, says."""
    sent = index.vectors.sparkSession.sparkContext.broadcast((names, matrix, wanted))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, wanted = sent.value
        kept: pd.DataFrame | None = None
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                asking = np.flatnonzero(wanted[:, cell])
                scores = np.round(np.stack(rows["vec"].to_numpy()).astype(np.float64) @ matrix[asking].T, digits)
                ids = rows["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                top = order[np.argsort(-scores[order], axis=0, kind="stable")[:top_k]]
                new = pd.DataFrame({"query_id": np.tile(names[asking], len(top)), "id": ids[top].ravel(), "score": np.take_along_axis(scores, top, 0).ravel()})
                kept = new if kept is None else pd.concat([kept, new])
            if kept is not None:
                kept = kept.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(top_k)
        if kept is not None:
            yield kept[["query_id", "id", "score"]]

    cells = np.flatnonzero(wanted.any(axis=0)).tolist()
    return index.vectors.filter(F.col("cell").isin(cells)).mapInPandas(best, schema)
