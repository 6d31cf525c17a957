from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from anbar.config import Config
from anbar.llm import embedding_dedup
from anbar.llm.embedding_dedup import forest, near_vectors, table_shape

SCHEMA = "vec_id long, embedding array<float>, rep int, id string"


def brute(ids, x, cosine=0.95):
    norm = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) >= cosine * np.outer(norm, norm)
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    root = forest(len(ids), a, b)
    return {i: (int(n), int(ids[r])) for i, n, r in zip(ids, near.sum(axis=1), root, strict=True)}


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_equals_all_pairs(spark, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 400)] + rng.standard_normal((400, 16)) * rng.choice([0.0, 0.12, 0.3], (400, 1))
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(400)
    order = np.argsort(ids)
    df = spark.createDataFrame([(int(i), v.tolist(), 0, "x") for i, v in zip(ids, x, strict=True)], SCHEMA)
    expected = brute(ids[order], x[order])
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, block_rows=block_rows).collect()}
    assert found == expected


def test_edge_vectors(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [None, 1.0]), (8, [math.inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]),
        (10, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None),
    ]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    out = Counter(map(tuple, near_vectors(df).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)]
    group = [(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False), (None, 4, 1, False)]
    assert out == Counter(alone + group)
    assert near_vectors(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b, c, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.01], [0.0, 0.0, 1.0]
    rows = [(5, a), (5, b), (7, a), (6, c), (None, d), (None, d), (None, [0.0, 0.0, 2.0]), (9, c)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    expected = [
        (5, 1, 5, True), (7, 1, 5, False), (5, 2, 5, True), (6, 2, 5, False), (9, 2, 5, False),
        *[(None, 2, None, True)] * 3,
    ]
    plain = Counter(map(tuple, near_vectors(df).collect()))
    assert plain == Counter(expected)
    # Neither lookup is broadcast whole.
    spread = near_vectors(df, cfg=Config(broadcast_rows=0))
    assert Counter(map(tuple, spread.collect())) == plain
    base = duckdb.connect()
    base.register("embeddings", df.select("vec_id", "embedding").toArrow())
    assert Counter(base.sql(embedding_dedup.SQL).fetchall()) == plain


def test_extreme_doubles(spark):
    rows = [
        (1, [1e-200, 0.0]), (2, [0.0, 1.0]), (3, [1e200, 0.0]), (4, [3e200, 1e199]), (5, [0.0, 5e-324]),
        (6, [1.7e308, 1.7e308]), (7, [2e-310, 2e-310]), (8, [-1e200, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert out == {1: (2, 1), 2: (1, 2), 3: (2, 1), 4: (2, 1), 5: (1, 2), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_shape_grows_slowly():
    assert table_shape(10, 0.95)[0] == 1
    bits, tables = table_shape(10**9, 0.95)
    assert bits == 20 and tables < 100


def test_query_of_the_smallest_table(spark):
    rows = embedding_dedup.op2_embedding_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["kept"] for r in rows) == len({r["component_id"] for r in rows})
