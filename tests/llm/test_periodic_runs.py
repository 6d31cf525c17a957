from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from anbar.llm.periodic_runs import (
    WORDS,
    collapsed,
    document_runs,
    op13_periodic_runs,
    periodic_runs,
    repeated_in_place,
    runs_of_texts,
)

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period by itself, word by word."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def made(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(200))]
    if kind == 1:
        return fibonacci(rng.randrange(1, 300))
    out = []
    size = rng.randrange(1, 600)
    while len(out) < size:
        part = [rng.choice("abc") for _ in range(rng.randrange(1, rng.choice([4, 10, 60])))]
        if rng.random() < 0.4:  # a small period within a larger one
            part = part[:2] * rng.randrange(1, 9) + part
        again = part * rng.randrange(1, 9)
        out += again[: rng.randrange(1, len(again) + 1)]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_equal_to_plain_runs(seed):
    rng = random.Random(seed)
    for _ in range(20):
        texts = [made(rng) for _ in range(15)]
        assert [[tuple(r) for r in runs] for runs in runs_of_texts(texts)] == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 63, 64, 100])
def test_each_period_at_its_least_length(period):
    unit = [f"w{i}" for i in range(period)]
    least = max(6, 4 * period)
    for size in (least - 1, least, least + 1):
        words = ["x", "y", *(unit * 7)[:size], "z"]
        expected = [(2, size, period)] if size >= least else []
        assert [tuple(r) for r in runs_of_texts([words])[0]] == expected


def test_large_period_of_small_ones():
    """Almost all places of the larger period lie in highly periodic regions."""
    words = (["a"] * 30 + ["b"]) * 5
    assert [tuple(r) for r in runs_of_texts([words])[0]] == plain_runs(words)


def test_texts_do_not_touch():
    assert runs_of_texts([["a"] * 3, ["a"] * 3, [], ["a"] * 6]) == [[], [], [], [(0, 6, 1)]]
    assert runs_of_texts([]) == []


def test_collapsed():
    words = "x a b a b a b a b y".split()
    runs = runs_of_texts([words])[0]
    assert [tuple(r) for r in runs] == [(1, 8, 2)]
    assert collapsed(words, runs) == "x a b y".split()


def test_half_a_million_words():
    rng = random.Random(5)
    words = [str(rng.randrange(1000)) for _ in range(100_000)]
    words = words[:50_000] + words[:1000] * 400 + words[50_000:]
    (run,) = (r for r in runs_of_texts([words])[0] if r.period == 1000)
    assert run.length >= 400_000


def test_edges(spark):
    rows = [
        (1, "a " * 7, "r"), (1, "a " * 7, "r"), (None, "b\tb\nb b b b", "r"), (2, None, "r"), (3, "", None),
        (4, " \n ", "r"), (5, "c d " * 60_000, "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = document_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    one = (1, 7, [(0, 7, 1)], "a")
    assert found == [
        (0, 6, [(0, 6, 1)], "b"), one, one, (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 120_000, [(0, 120_000, 2)], "c d"),
    ]
    assert document_runs(docs.limit(0)).count() == 0


def test_rewrite_leaves_rows_without_id_alone():
    assert repeated_in_place(None, ["a", "b"]) == ["a", "b"]
    assert repeated_in_place(1, []) == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_row(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = op13_periodic_runs(spark, SF)
    assert out.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    found = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert found == {k: expected_row(k, t) for k, t in docs}
    assert sum(r[0] > 0 for r in found.values()) > 5


def test_numbers_need_no_order():
    import numpy as np

    assert periodic_runs(np.array([9, 2, 9, 2, 9, 2, 9, 2])) == [(0, 8, 2)]
    assert periodic_runs(np.array([], np.int64)) == []
