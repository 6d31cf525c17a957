"""The paths taken by large or skewed inputs, checked against brute force."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.operators import prefix
from anbar.operators.joins import join_counted
from anbar.operators.prefix import (
    breakpoints,
    dense_positions,
    exact_quantiles,
    running_totals,
)
from anbar.plans.session import ensure_checkpoint_dir

CFG = Config()


@pytest.fixture()
def many_blocks(spark, monkeypatch):
    """Small blocks, and Spark does not merge small partitions."""
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 200)
    monkeypatch.setattr(prefix, "STRIDE", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed_rows(n: int = 3000) -> list[tuple[int, int, int]]:
    """(group, order, value): group 0 owns most of the rows."""
    rng = random.Random(7)
    return [(0 if i % 3 else rng.randrange(1, 40), i, rng.randrange(0, 50)) for i in range(n)]


def test_running_totals_across_blocks(many_blocks):
    rows = skewed_rows()
    df = many_blocks.createDataFrame(rows, "g int, o int, v bigint")
    out = running_totals(df, ["g"], [-F.col("o")], {"v": F.col("v"), "n": F.lit(1)})
    got = {(r["g"], r["o"]): (r["run_v"], r["total_v"], r["run_n"], r["total_n"])
           for r in out.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        total, run = sum(r[2] for r in mine), 0
        for i, (_, o, v) in enumerate(mine, start=1):
            run += v
            want[g, o] = (run, total, i, len(mine))
    assert got == want


def test_hot_group_is_spread_over_blocks(many_blocks):
    df = many_blocks.createDataFrame(skewed_rows(), "g int, o int, v bigint")
    out = running_totals(df, ["g"], [F.col("o")], {"v": F.col("v")})
    tasks = out.where("g = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 1000


def test_blocks_are_the_same_in_every_job(many_blocks):
    """Block ids come from the rows, not from their partitions; null groups count, too."""
    rows = [(None if i % 2 else 1, i, 1) for i in range(2000)]
    df = many_blocks.createDataFrame(rows, "g int, o int, v bigint")
    for parts in (1, 7):
        out = running_totals(df.repartition(parts), ["g"], [F.col("o")], {"v": F.col("v")})
        got = {r["o"]: (r["run_v"], r["total_v"]) for r in out.collect()}
        assert got == {i: (i // 2 + 1, 1000) for i in range(2000)}


def test_rows_cross_one_exchange(spark):
    df = spark.createDataFrame(skewed_rows(), "g int, o int, v bigint")
    out = running_totals(df, ["g"], [F.col("o")], {"v": F.col("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


def test_exact_quantiles_equal_numpy(many_blocks):
    rng = np.random.default_rng(3)
    groups = {g: rng.normal(size=n).round(2) for g, n in {1: 2000, 2: 9, 3: 1, 4: 2, 5: 777}.items()}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = many_blocks.createDataFrame(rows, "g int, v double")
    counted = df.groupBy("g", "v").agg(F.count("*").alias("c"))
    out = {r["g"]: r for r in exact_quantiles(counted, ["g"], "v", "c", (0.25, 0.75)).collect()}
    for g, values in groups.items():
        assert out[g]["n"] == len(values)
        np.testing.assert_allclose(out[g]["q"], np.quantile(values, [0.25, 0.75]), atol=1e-12)


def test_breakpoints_are_order_statistics(many_blocks):
    values = [float(v) for v in range(1, 38)]
    df = many_blocks.createDataFrame([(v,) for v in values], "v double").withColumn(
        "c", F.lit(1).cast("bigint")
    )
    got = breakpoints(df, [], "v", "c", 10).first()["v"]
    assert got == [values[-(-37 * i // 10) - 1] for i in range(1, 10)]


def test_dense_positions(many_blocks):
    codes = random.Random(1).sample(range(10_000), 500)
    df = many_blocks.createDataFrame([(c,) for c in codes], "code int")
    got = {r["code"]: r["pos"] for r in dense_positions(df, [F.col("code")], "pos").collect()}
    assert got == {c: i for i, c in enumerate(sorted(codes))}


@pytest.mark.parametrize(("rows", "size"), [(1000, 1 << 20), (0, 1 << 20), (1000, 100)])
def test_join_counted_paths_agree(spark, rows, size):
    cfg = replace(CFG, broadcast_rows=rows, broadcast_bytes=size, hot_per_partition=1)
    rows = [(r[0], r[1]) for r in skewed_rows()] + [(None, -1), (99, -2)] + [(0, 1)] * 5
    left = spark.createDataFrame(rows, "k int, id int")
    right = left.where("k IS NOT NULL AND k < 90").groupBy("k").agg(F.count("*").alias("n"))
    right = right.withColumn("x", F.col("k") * 10)
    out = join_counted(left, right, ["k"], "n", cfg)
    assert out.columns == ["k", "id", "x"]
    got = sorted((r["k"] is None, r["k"] or 0, r["id"], r["x"]) for r in out.collect())
    want = sorted(
        (k is None, k or 0, i, None if k is None or k >= 90 else k * 10) for k, i in rows
    )
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]


def test_hot_keys_do_not_meet_in_one_task(spark):
    """On the shuffle path the rows of the hot key leave under many spread values."""
    cfg = replace(CFG, broadcast_rows=0, hot_per_partition=1)
    left = spark.createDataFrame([(r[0], r[1]) for r in skewed_rows()], "k int, id int")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = join_counted(left, right, ["k"], "n", cfg)
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)


def test_checkpoint_dir_is_read_from_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
