from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import anbar.llm.lexical_search as lexical
from anbar.llm.lexical_search import Best, op11_lexical_search, search, terms_of
from catalog.compare import compare, connect

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    """Every document for every item."""
    texts = [(key, plain_terms(t)) for key, t in docs]
    n_docs = sum(bool(t) for _, t in texts)
    n_terms = sum(len(t) for _, t in texts)
    df = Counter(t for _, words in texts for t in set(words))
    out = []
    for item, text in items:
        scores = []
        for key, words in texts:
            tf, score = Counter(words), 0
            for term in plain_terms(text):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 25 + 25 * len(words) * n_docs // n_terms
                    score += w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0))
        for rank, (score, null, key) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else key, -score))
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]  # ties
    rng.shuffle(docs)
    items = [(i, ", ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    monkeypatch.setattr(lexical, "BLOCKS", 3)
    docs, items = made(seed)
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(search(a, b, k=5)) == sorted(plain_search(docs, items, 5), key=str)


def test_shards_and_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = made(9)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = found(search(a, b))
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 300)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    assert found(search(a, b)) == whole == sorted(plain_search(docs, items), key=str)


def test_skips_most_blocks():
    """Documents that only hold frequent terms are not scored once rare ones fill the results."""
    rng = np.random.default_rng(1)
    n = 64 * 200
    common = [lexical.Postings(np.arange(n), np.full(n, s), np.full(200, s)) for s in (3, 2)]
    places = np.concatenate([np.arange(20) * 100, np.sort(rng.choice(np.arange(2000, n), 60, replace=False))])
    scores = np.repeat([200, 100], [20, 60])
    rare = lexical.Postings(places, scores, lexical.block_bounds(places, scores, 200))
    shard = object.__new__(lexical.Shard)
    shard.keys, shard.blocks, shard.ranks = list(range(n)), 200, np.arange(n)
    shard.lists = {1: common[0], 2: common[1], 3: rare}
    scored = []
    plain = lexical._scored
    lexical._scored = lambda lists, a, b, least: scored.append(b - a) or plain(lists, a, b, least)
    try:
        best = Best(20)
        shard.search([(1, 1), (2, 1), (3, 1)], best)
    finally:
        lexical._scored = plain
    assert [r[2] for r in best.rows] == places[:20].tolist()
    assert sum(scored) < 60


def test_terms():
    text = "Ab-CD  éÉx_9\x00٣!<z> Y"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
    assert terms_of(None) == terms_of(b"") == terms_of(b"-- !") == []


def test_edges(spark):
    docs = [(1, "cat dog"), (1, "cat dog"), (1, "cat"), (None, "cat dog"), (2, None), (3, ""), (4, "?"), (5, "dog " * 50_000)]
    items = [(7, "cat cat DOG"), (7, "dog"), (None, "cat"), (8, None), (9, ""), (10, "unknown"), (11, "Cat")]
    a = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, score int")
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert found(search(a, b)) == sorted(plain_search(docs, items), key=str)
    assert search(a.limit(0), b).count() == 0
    assert search(a, b.limit(0)).count() == 0
    assert search(a.where("text is null"), b).count() == 0


def test_keys_of_other_types(spark):
    a = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z"), ("d", "z")], "id string, t string")
    b = spark.createDataFrame([(1, "x")], "q int, text string")
    rows = [r[:3] for r in search(a, b, k=2, key="id", text="t", item_key="q").orderBy("rank").collect()]
    assert rows == [(1, 1, "a"), (1, 2, "b")]


def test_query(spark):
    rows, problems = compare(op11_lexical_search(spark, SF), connect(SF), lexical.SQL)
    assert rows and not problems
