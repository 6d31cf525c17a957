"""Every stage of the pipeline against a plain version, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anbar.llm.common import WORD, written
from anbar.llm.quality import document_stats, learned_from, verdict
from tests.llm.test_minhash_dedup import all_pairs
from tests.llm.test_packing import best_fit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        out.append(docs)
    return out


def plain(df):
    return {r["doc_id"]: r for r in df.collect()}


def edit_distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def test_columns(stages):
    for df in stages[:5]:
        assert df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    stats = document_stats(stages[0])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, _ = verdict(learned_from(stats, labels))
    assert set(plain(stages[1])) == {r["doc_id"] for r in stats.where(kept).collect()}
    passed = {r["doc_id"] for r in stats.where("not base_failed").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & passed
    assert len(good & set(plain(stages[1]))) > 0.97 * len(good)


def test_lines(stages):
    seen, expected = [], {}
    for i, row in sorted(plain(stages[1]).items()):
        lines = []
        for raw in row["text"].split("\n"):
            line = raw.strip(" \t\r\x0b\x0c")
            near = len(line) >= 16 and any(len(x) >= 16 and edit_distance_at_most_one(line, x) for x in seen)
            if not line or not (near or line in seen):
                lines.append(raw)
            if line:
                seen.append(line)
        expected[i] = "\n".join(lines)
    found = plain(stages[2])
    assert {i: r["text"] for i, r in found.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_near_duplicates(stages):
    texts = {i: r["text"] for i, r in plain(stages[2]).items()}
    texts = {i: t for i, t in texts.items()}
    roots = all_pairs({i: t for i, t in texts.items() if t.split()})
    blank = [i for i, t in texts.items() if not t.split()]
    assert set(plain(stages[3])) == set(roots.values()) | ({min(blank)} if blank else set())


def test_mix_and_packing(stages):
    docs, mixed = plain(stages[3]), stages[4].collect()
    assert all(tuple(r) == tuple(docs[r["doc_id"]]) for r in mixed)
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 2
    words = F.regexp_count("text", F.lit(WORD)).alias("n")
    before = stages[3].agg(F.sum(words)).first()[0]
    assert stages[4].agg(F.sum(words)).first()[0] == pytest.approx(1.5 * before, rel=0.1)
    rows = stages[5].collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies
    lengths = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) == best_fit(lengths, 2048)


def test_run_agrees_with_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, SF).select(columns).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, stages[5].select(columns).collect()))


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, shard int"
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (2, None), (3, ""), (4, words), (5, words + " more"), (None, words[1:]), (6, words.upper()), (6, words.upper())]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.count() >= 1
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, SF))
    assert none.count() == 0


def test_verdicts_go_by_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, shard int"
    good = [" ".join(f"{name}{i}" for i in range(60)) for name in ("apple", "birch", "cedar")]
    texts = [
        (1, "too short"), (1, good[0]), (None, "short"), (None, good[1]), (None, good[1]),
        (7, good[1]), (2, good[2]), (2, good[2]), (3, good[2] + " more"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, None, None, 0, "x", 1) for i, t in texts], schema)
    passed = corpus_pipeline.quality_rules(spark, docs, SF)
    assert passed.dtypes == docs.dtypes
    expected = Counter(x for x in texts if x[1] and "short" not in x[1])
    assert Counter((r["doc_id"], r["text"]) for r in passed.collect()) == expected
    single = corpus_pipeline.near_dedup(spark, passed, SF)
    assert single.dtypes == docs.dtypes
    assert Counter((r["doc_id"], r["text"]) for r in single.collect()) == Counter(
        [(1, good[0]), (7, good[1]), (2, good[2])]
    )
