from __future__ import annotations

import random

from anbar.llm.components import components


def test_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(300, 300)]
    rng.shuffle(edges)
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0}
    assert {out[i] for i in range(100, 131)} == {100}
    assert {out[i] for i in (200, 201, 202)} == {200}
    assert 300 not in out
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
