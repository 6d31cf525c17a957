from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from anbar.llm.common import per_text
from anbar.llm.quality import FEATURES, judged, learn_rules, op6_quality_rules, repeated_words

SF = "/root/testdata/sf0.01"


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = [any(windows[tuple(words[s:s + 8])] > 1 for s in range(max(0, i - 7), min(i, len(words) - 8) + 1))
              for i in range(len(words))]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), sum(inside))


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice("abc") for _ in range(rng.choice([0, 7, 8, 9, 60, 300]))]
    words = words * 2 if seed % 2 else ["x"] * 9 + words
    assert repeated_words(words) == naive(" ".join(words))[4]


def test_query_equals_naive_counts(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()}
    rows = op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = naive(texts[r["doc_id"]])
        assert tuple(r)[1:6] == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
    known = [(r["kept"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    good = [k for k, q in known if q == 1]
    bad = [k for k, q in known if q == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.1


def test_rules_find_a_planted_list():
    rng = np.random.default_rng(4)
    x = {name: rng.random(4000) for name in FEATURES}
    bad = ((x["symbols_per_word"] > 0.8) & (x["words"] <= 0.6)) | (x["upper_share"] > 0.9)
    rules = learn_rules(x, bad)
    found = np.zeros(4000, bool)
    for rule in rules:
        held = np.ones(4000, bool)
        for c in rule.conditions:
            held &= c.holds(x[c.feature])
        found |= held
    assert (found == bad).mean() > 0.99
    assert learn_rules(x, np.zeros(4000, bool)) == []


def test_edges(spark):
    schema = "doc_id long, text string, kept string, n_words int"
    long_text = " ".join(f"w{i}" for i in range(50_000))
    docs = spark.createDataFrame(
        [(1, None, "x", 0), (2, "", "x", 0), (2, "", "x", 0), (3, long_text, "x", 0), (None, "a " * 30, "x", 0)], schema)
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 1)], "doc_id long, quality int")
    out = judged(docs, labels).collect()
    assert len(out) == 5
    assert {(r["doc_id"], r["kept"]) for r in out} == {(1, False), (2, False), (3, True), (None, False)}
    assert judged(docs.limit(0), labels).count() == 0
    assert judged(docs, labels.limit(0)).count() == 5


def test_bounded_fit(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bounded = judged(docs, labels, fit_rows=150).where("not base_failed")
    wrong = bounded.join(labels, "doc_id").where("kept <> (quality = 1)")
    assert wrong.count() <= 5


def test_batches_end_by_their_bytes(spark):
    docs = spark.range(0, 24, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text")

    def batch_chars(texts):
        return [(sum(map(len, texts)),)] * len(texts)

    found = per_text(docs, "doc_id", "text", "chars long", batch_chars).collect()
    assert len(found) == 24 and max(r["chars"] for r in found) <= 6_000_000
