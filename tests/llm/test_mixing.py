from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anbar.llm import mixing
from anbar.llm.common import word_count


def shared_out(sizes, weights, share=1.5, limit=2.0):
    """Targets by repeated sharing, as the words of the definition go."""
    total, full = share * sum(sizes), set()
    while True:
        left = total - sum(limit * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        target = [limit * s if i in full else left * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and target[i] > limit * s}
        if not over:
            return target
        full |= over


@pytest.fixture(scope="module")
def docs(spark):
    names = ["a", "b", "Z", "é", None, "c", "empty"]
    rows = []
    for i in range(3000):
        source = names[0] if i % 3 else names[1 + i // 3 % 6]
        size = 0 if source == "empty" else 1 + i * 7919 % 400
        rows.append((i, source, size, "x", 1))
    return spark.createDataFrame(rows, "doc_id long, source string, size long, shard string, row int")


def test_targets_equal_repeated_sharing(docs):
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    known = [i for i, s in enumerate(order) if sizes[s]]
    expected = shared_out([sizes[order[i]] for i in known], [weights[i] for i in known])
    found = {r["source"]: r["target"] for r in mixing.source_targets(docs).collect()}
    assert found.pop("empty") == 0
    assert found == pytest.approx({order[i]: t for i, t in zip(known, expected, strict=True)})


def test_mix_reaches_targets_and_reruns_agree(docs):
    targets = {r["source"]: r["target"] for r in mixing.source_targets(docs).collect()}
    settings = {"docs_per_block": 16, "shard_words": 20_000}
    mixed = mixing.mix(docs, F.col("size"), **settings).collect()
    again = mixing.mix(docs.repartition(5), F.col("size"), **settings).collect()
    assert sorted(mixed, key=str) == sorted(again, key=str)
    assert mixed[0]["row"].asDict().keys() == set(docs.columns)
    taken, copies = Counter(), Counter()
    for r in mixed:
        taken[r["row"]["source"]] += r["row"]["size"]
        copies[r["row"]["doc_id"]] += 1
    assert max(copies.values()) == 2
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 400
    shards = Counter(r["shard"] for r in mixed)
    assert set(shards) == set(range(round(sum(targets.values()) / 20_000)))
    places = Counter((r["row"]["doc_id"], r["pass"]) for r in mixed)
    assert max(places.values()) == 1  # a document is drawn once in a pass


def test_splitting_tree_deals_all(spark):
    quotas = spark.createDataFrame([(1, 50), (2, 3), (3, 200)], "source_no long, quota long")
    dealt = mixing.split_quotas(quotas, 7, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in dealt:
        by_source[r["source_no"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert by_source == {1: 50, 2: 3, 3: 200}
    assert set(by_shard.values()) <= {36, 37} and sum(by_shard.values()) == 253


def test_hypergeometric_distribution(spark):
    n, population, marked, drawn = 20_000, 40, 12, 15
    u = (F.col("id") + 0.5) / n
    args = [F.lit(x).cast("long") for x in (population, marked, drawn)]
    found = spark.range(n).select(mixing.hypergeometric(*args, u).alias("k")).groupBy("k").count().collect()
    for r in found:
        k = r["k"]
        p = math.comb(marked, k) * math.comb(population - marked, drawn - k) / math.comb(population, drawn)
        assert r["count"] / n == pytest.approx(p, abs=2 / n)
    edge = spark.range(3).select(mixing.hypergeometric(
        F.lit(10).cast("long"), F.lit(10).cast("long"), F.lit(4).cast("long"), F.lit(0.99)).alias("k"))
    assert {r["k"] for r in edge.collect()} == {4}


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, "a", None), (None, None, "  ")], "doc_id long, source string, text string")
    assert mixing.mix(docs, word_count(F.col("text"))).count() == 0
    assert mixing.mix(docs.limit(0), word_count(F.col("text"))).count() == 0
    one = spark.createDataFrame([(1, None, "a b c"), (1, None, "a b c")], "doc_id long, source string, text string")
    assert mixing.mix(one, word_count(F.col("text"))).count() in (2, 4)


def test_taken_goes_by_row(spark, tmp_path):
    """Repeated and null ids: no row has more than twice its size, and equal rows have the same."""
    rows = [(None, "x", 10 + i % 3) for i in range(30)] + [(None, None, 10)] * 3
    rows += [(1, "x", 10), (1, "x", 10), (1, "y", 7), (1, "y", 9)] + [(i, "y", 20) for i in range(2, 60)]
    docs = spark.createDataFrame([(a, b, "w " * n) for a, b, n in rows], "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op7_mixing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by_source, targets = Counter(), {}
    for r in out:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["n_taken"] * r["size"]
        by_source[r["source_size"]] += r["taken"]
        targets[r["source_size"]] = r["target"]
    for source_size, target in targets.items():
        # Equal rows go together, at most three here.
        assert abs(by_source[source_size] - target) <= 1.5 * 20 + 10
    assert len({(r["taken"]) for r in out if (r["doc_id"], r["size"], r["source_size"]) == (1, 10, by_x(rows))}) == 1


def by_x(rows):
    return sum(n for _, source, n in rows if source == "x")
