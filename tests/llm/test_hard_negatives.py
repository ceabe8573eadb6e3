"""Hard negatives against brute force in plain integers, and the bounds of the approximation against exact scores."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import queries, sql
from folio.llm.hard_negatives import CELLS, Cells, Mining, cells_of, integer_vectors, mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string"


def brute(rows, mining: Mining, anchors) -> Counter:
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y, _ in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, a, y in kept:
        if not anchors(i):
            continue
        same = sorted((-dot(a, b), j) for j, b, z in kept if z == y and j != i)[: mining.positives]
        others = sorted((-dot(a, b), j) for j, b, z in kept if z != y)
        for p, j in same:
            inside = [(s, k) for s, k in others if mining.least * -p <= 100 * -s <= mining.most * -p][: mining.negatives]
            out.update((i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside, 1))
    return out


def vectors(n: int, size: int, seed: int, grain: float = 0.0):
    rng = random.Random(seed)
    cut = (lambda x: round(x / grain) * grain) if grain else (lambda x: x)
    return [(i, [cut(rng.gauss(0.1, 0.3)) for _ in range(size)], rng.randrange(3), "x") for i in range(n)]


@pytest.mark.parametrize("mining", [Mining(), Mining(rows_a_block=17, anchors_a_block=3), Mining(positives=2, negatives=4, rows_a_block=50)])
def test_same_as_brute_force(spark, mining):
    rows = vectors(160, 12, 1) + [(1000 + i, v, y, q) for i, v, y, q in vectors(90, 12, 2, grain=0.25)]  # coarse ones tie
    df = spark.createDataFrame(rows, SCHEMA)
    got = mine_negatives(integer_vectors(df), F.col("vec_id") % 10 == 0, mining).collect()
    want = brute(rows, mining, lambda i: i % 10 == 0)
    assert len(got) > 100 and Counter(map(tuple, got)) == want


def test_odd_rows(spark):
    rows = vectors(40, 6, 3, grain=0.25)
    odd = [
        (None, [0.5] * 6, 1, "x"), (50, None, 1, "x"), (51, [0.5] * 6, None, "x"), (52, [], 1, "x"), (53, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (54, [math.nan] + [0.0] * 5, 1, "x"),
        (55, [math.inf] + [0.0] * 5, 1, "x"), (56, [-math.inf] + [0.0] * 5, 1, "x"), (60, [0.0] * 6, 2, "x"), (61, [0.5] * 3, 2, "x"), (70, [1.0] * 9, 0, "x"),
    ]
    rows += odd + rows[:12]  # repeated whole, anchors too
    got = mine_negatives(integer_vectors(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 10 == 0, Mining(rows_a_block=9)).collect()
    assert Counter(map(tuple, got)) == brute(rows, Mining(), lambda i: i % 10 == 0)


def test_empty_and_without_anchors(spark):
    empty = integer_vectors(spark.createDataFrame([], SCHEMA))
    assert mine_negatives(empty, F.lit(True)).count() == 0
    some = integer_vectors(spark.createDataFrame(vectors(5, 4, 4), SCHEMA))
    assert mine_negatives(some, F.lit(None).cast("boolean")).count() == 0
    one = integer_vectors(spark.createDataFrame(vectors(1, 4, 5), SCHEMA))
    assert mine_negatives(one, F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_and_tell_rows_apart():
    rng = np.random.default_rng(6)
    q = rng.integers(-900, 900, (3000, 64))
    cells = Cells(q.min(axis=0), (q.max(axis=0) - q.min(axis=0)) // CELLS + 1)
    codes = cells.of(q).astype(int)
    for anchor in q[:20]:
        most, spread = cells.tables(anchor)
        upper, score = most[np.arange(64), codes].sum(axis=1), q @ anchor
        assert (score <= upper).all() and (score >= upper - spread).all()
        # of 3,000 rows, few can be among the ten best
        floor = np.sort(upper - spread)[-10]
        assert (upper >= floor).sum() < 300


def test_cells_cover_all_rows(spark):
    rows = vectors(200, 5, 7)
    q = integer_vectors(spark.createDataFrame(rows, SCHEMA))
    cells = cells_of(q)
    m = np.array([r.q for r in q.collect()])
    codes = (m - cells.low) // cells.width
    assert codes.min() >= 0 and codes.max() < CELLS


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_is_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    want = Counter(duckdb.sql(sql.OP11.replace("from embeddings", f"from '{path}/embeddings.parquet'")).fetchall())
    assert Counter(map(tuple, queries.op11_hard_negatives(spark, path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
