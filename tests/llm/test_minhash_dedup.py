from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from anbar.llm import minhash_dedup as m
from anbar.llm.embedding_dedup import forest

SF = "/root/testdata/sf0.01"


def all_pairs(texts, similarity=0.8):
    """Components over all pairs: (id -> smallest id), and the similarities near the border."""
    ids = sorted(texts)
    found = [s for _, s in m._each_text([texts[i] for i in ids])]
    counts = np.zeros(1 << m.BUCKET_BITS)
    for s in found:
        counts[np.unique(m.bucket(s))] += 1
    idf = m.damped_idf(counts, len(ids))
    sets = [m.weighted(s, idf) for s in found]
    a, b = [], []
    for i in range(len(ids)):
        for j in range(i):
            if m.weighted_jaccard(sets[i], sets[j]) >= similarity:
                a.append(i)
                b.append(j)
    root = forest(len(ids), np.array(a, int), np.array(b, int))
    return {i: ids[r] for i, r in zip(ids, root, strict=True)}


def corpus(seed, n=150):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(pool) for _ in range(rng.choice([60, 120, 300]))] for _ in range(25)]
    texts = {}
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            words[rng.randrange(len(words))] = rng.choice(pool)
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize(("cell_rows", "cross_rows"), [(64, 1024), (3, 1024), (3, 5)])
def test_equals_all_pairs(spark, cell_rows, cross_rows):
    texts = corpus(5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = m.near_duplicates(docs, cell_rows=cell_rows, cross_rows=cross_rows, bands=20)
    out = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert out == all_pairs(texts)


def test_one_large_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(400):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = m.near_duplicates(docs, cell_rows=16).collect()
    assert {r["component_id"] for r in out} == {0}


def test_samples_collide_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.integers(0, 2**63, 120, dtype=np.uint64))
    wa, wb = rng.choice([1.0, 1.7, 2.4, 3.1], 120), rng.choice([1.0, 1.7, 2.4, 3.1], 120)
    a, b = (ids[:100], wa[:100]), (ids[20:], np.concatenate([wa[20:70], wb[70:]]))
    k = 4000
    got = m.consistent_samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 100]), k)
    assert (got[0] == got[1]).mean() == pytest.approx(m.weighted_jaccard(a, b), abs=0.03)


def test_weighted_jaccard_and_shingles():
    idf = np.ones(1 << m.BUCKET_BITS)

    def of(text):
        words, _ = m.word_hashes([text])
        return m.weighted(m.shingles(words), idf)

    def naive(a, b):
        def weights(t):
            w = t.lower().split()
            k = min(5, len(w))
            return {s: 1 + np.log(c) for s, c in Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)).items()}
        a, b = weights(a), weights(b)
        keys = set(a) | set(b)
        return sum(min(a.get(s, 0), b.get(s, 0)) for s in keys) / sum(max(a.get(s, 0), b.get(s, 0)) for s in keys)

    x, y = "a b c d e f a b c d e f g h", "A  b\tc d e f g h é"
    assert m.weighted_jaccard(of(x), of(y)) == pytest.approx(naive(x, y))
    assert m.weighted_jaccard(of("a b"), of("A B")) == 1.0
    assert m.weighted_jaccard(of("a b"), of("b a")) == 0.0
    words, counts = m.word_hashes(["", "one", " \n", "two  words", "x" * 9000])
    assert counts.tolist() == [0, 1, 0, 2, 1] and len(set(words.tolist())) == 4


def test_edges(spark):
    text = "some words that make up a text of more than five words"
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (5, text.upper()), (None, text), (6, "a"), (7, "a"),
            (8, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, component_id string")
    out = m.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    verdict = {r["doc_id"]: (r["component_id"], r["kept"]) for r in out}
    assert verdict == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (4, False), None: (None, True),
                       6: (6, True), 7: (6, False), 8: (8, True)}
    assert m.near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = {r["doc_id"]: r["component_id"] for r in m.op8_minhash_near_dedup(spark, SF).collect()}
    # Texts without five equal words in a row cannot link, so all pairs of the others suffice.
    expected = all_pairs(texts)
    assert sum(out[i] != expected[i] for i in out) <= 2


def test_production_bands_follow_the_miss_probability(monkeypatch):
    given = []
    monkeypatch.setattr(m, "document_frequencies", lambda docs, text: np.ones(3))

    def signatures(docs, key, text, idf, bands, rows):
        given.append((1 - 0.8**rows) ** bands)
        raise StopIteration

    monkeypatch.setattr(m, "_signatures", signatures)
    with pytest.raises(StopIteration):
        m.near_duplicates(None)
    assert given[0] <= 2e-4
    assert m.bands_for(1.0, 3, 2e-4) == 1
    assert m.bands_for(0.8, 3, 2e-4) == 12
