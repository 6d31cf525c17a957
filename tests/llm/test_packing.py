from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from anbar.llm import packing
from anbar.llm.packing import Tree, op3_packing, pack, pieces, place, plan, sequences, token_ids, vocabulary, written


def best_fit(lengths, size):
    """One piece at a time."""
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        if i == len(rooms):
            used += 1
            room = size
        else:
            room = rooms.pop(i)
        bisect.insort(rooms, room - n)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_piecewise_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 2048])
    histogram = Counter(rng.randint(1, size) ** 2 // size + 1 for _ in range(3000))
    histogram = Counter({min(k, size): v for k, v in histogram.items()})
    runs = plan(histogram, size)
    fill = defaultdict(list)
    for length, _, count, first, each, offset in runs:
        for i in range(count):
            fill[first + i // each].append((offset + i % each * length, length))
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(fill) == list(range(len(fill)))
    assert len(fill) == best_fit(list(histogram.elements()), size)
    assert Counter(n for p in fill.values() for _, n in p) == histogram


def test_tree():
    tree = Tree(20)
    assert tree.tightest(0) is None
    for c in (3, 7, 20):
        tree.set(c, True)
    assert [tree.tightest(x) for x in (0, 3, 4, 8, 20)] == [3, 3, 7, 20, 20]
    tree.set(20, False)
    assert tree.tightest(8) is None


def test_ids_equal_the_tokenizer():
    texts = [
        "plain words, don't we'll  two  spaces \n\n new line\t tab ", "naïve café Größe 12 345", "日本語 texts",
        "a b  c \x1f d", "x² Ⅷ ½", "<|endoftext|> <| x", "", "emoji 😀 — “quoted” … ©", "_a_ __b 'S 's",
        "tail   ", "\r\n\r\n a", "ǅ ʰ ſ",
    ]
    tokenizer = Tokenizer.from_file(vocabulary())
    ids = token_ids(vocabulary())
    for t, found in zip(texts, ids.of_each(texts, chars=30), strict=True):
        assert found.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check(rows, texts, size):
    tokenizer = Tokenizer.from_file(vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // size)))
        assert all(r["length"] == size for r in mine[1:])
        end = 0
        for r in mine:
            assert r["start"] == end
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:end].tobytes())
        assert end == len(ids)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    assert len(by_sequence) == best_fit([r["length"] for r in rows], size)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op3_packing(spark, sf).collect(), texts, 2048)


def test_edges_and_round_trip(spark):
    texts = [(1, None), (2, ""), (3, "word " * 500), (None, "lost id"), (5, "a b c"), (6, "a b c")]
    schema = "doc_id long, text string, length int, ids string"
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], schema)
    packed = pack(docs, vocabulary(), size=100, keep_ids=True)
    rows = packed.collect()
    check(rows, texts, 100)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    tokenizer = Tokenizer.from_file(vocabulary())
    mine = sorted((r for r in rows if r["doc_id"] == 3), key=lambda r: r["piece"])
    ids = [x for r in mine for x in whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]]
    assert tokenizer.decode(ids[:-1]) == "word " * 500 and ids[-1] == 0
    assert pack(docs.limit(0), vocabulary()).count() == 0
    twice = pack(docs.where("doc_id = 5").unionAll(docs.where("doc_id = 5")), vocabulary()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_small_counts_make_no_file_per_shuffle_partition(spark, monkeypatch):
    kept = {
        "spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in kept}
    tables = []
    monkeypatch.setattr(packing, "written", lambda df: tables.append(written(df)) or tables[-1])
    docs = spark.createDataFrame([(i, "a " * (i % 90)) for i in range(400)], "doc_id long, text string")
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        packed = pack(docs.coalesce(2), vocabulary(), size=50)
        assert packed.rdd.getNumPartitions() <= 2 and len(tables) == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_counts_that_are_not_broadcast_place_alike(spark):
    texts = [(i, "a " * (i % 90)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    cut = written(pieces(docs, vocabulary(), size=50))
    rows = place(cut, 50, broadcast_rows=0).collect()
    check(rows, texts, 50)
    assert sorted(rows) == sorted(place(cut, 50).collect())


def test_texts_are_read_in_short_batches(spark, monkeypatch):
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    monkeypatch.setattr(packing, "written", lambda df: seen.append(spark.conf.get(key)) or written(df))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    pack(docs, vocabulary()).collect()
    assert int(seen[0]) <= 256 and spark.conf.get(key) == "4096"
    spark.conf.set(key, "999")
    try:
        pack(docs, vocabulary()).collect()
        assert seen[1:] == ["999"] and spark.conf.get(key) == "999"
    finally:
        spark.conf.unset(key)
