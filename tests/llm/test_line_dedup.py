from __future__ import annotations

import random

import duckdb
import pytest

from anbar.llm.line_dedup import SQL, line_dedup
from catalog.compare import compare

SCHEMA = "doc_id long, text string, kept string, line int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_earliest_of_near_lines_stays(spark):
    line = "the quick brown fox jumps over the lazy dog"
    docs = rows_of(spark, [
        (1, f"{line}\n\nsecond line of the first text"),
        (2, f"  {line}!\nquite another line of text here"),        # one insertion
        (3, line.replace("fox", "fax") + "\n" + line[1:] + "\n" + line[:-1]),  # one edit each
        (4, line.replace("fox", "cat")),                            # three edits
        (5, "short\nshore\nshort"),                                 # too short for near copies
    ])
    out = texts(line_dedup(docs))
    assert out[1] == f"{line}\n\nsecond line of the first text"
    assert out[2] == "quite another line of text here"
    assert out[3] == ""
    assert out[4] == line.replace("fox", "cat")
    assert out[5] == "short\nshore"


def test_edge_rows(spark):
    long_line = "abcdefghij " * 4000
    docs = rows_of(spark, [
        (None, "a line that has no document"), (1, None), (2, ""), (3, " \n\t\n"),
        (4, "a line that has no document"), (5, long_line), (5, long_line),
        (6, long_line[:20000] + "#" + long_line[20001:]),
    ])
    df = line_dedup(docs, report={"lines": "n", "kept": "k"})
    assert df.columns == [*docs.columns, "n", "k"]
    found = [(r["doc_id"], r["text"], r["n"], r["k"]) for r in df.collect()]
    by = {f[0]: f for f in found}
    assert len(found) == 8
    assert by[None][1:] == ("a line that has no document", 1, 1)
    assert by[1][1:] == (None, 0, 0)
    assert by[2][1:] == ("", 0, 0)
    assert by[3][1:] == (" \n\t\n".removesuffix("\n") + "\n", 0, 0)
    assert by[4][1:] == ("", 1, 0)
    assert [f[1:] for f in found if f[0] == 5] == [(long_line, 1, 1)] * 2  # a repeated row
    assert by[6][3] == 0
    assert line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines_equal_all_pairs(spark, seed):
    rng = random.Random(seed)

    def edited(line):
        at, kind = rng.randrange(len(line)), rng.randrange(3)
        return line[:at] + ("", "z", "z" + line[at])[kind] + line[at + 1:]

    pool = ["".join(rng.choice("ab ") for _ in range(rng.choice([15, 16, 17, 64, 65, 130]))) for _ in range(60)]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(3)]
        rows.append((i, "\n".join(edited(x) if rng.random() < 0.6 else x for x in lines)))
    docs = rows_of(spark, rows).select("doc_id", "text")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    from pyspark.sql import functions as F

    out = line_dedup(docs, report={"lines": "n_lines", "kept": "n_kept"})
    out = out.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))
    n, problems = compare(out, con, SQL)
    assert n == 120 and not problems


def test_repeated_and_null_ids(spark):
    """One id on two texts, and texts without an id: no line is written twice, none is lost."""
    first, second = "line number one, long\nline number two, long", "another line, long one\nline number one, long"
    docs = rows_of(spark, [(1, first), (1, second), (None, "alpha line, long"), (None, "beta line, long enough"),
                           (None, "gamma line, long enough\nalpha line, long"), (2, "gamma line, long enough")])
    found = [r["text"] for r in line_dedup(docs).collect()]
    lines = sorted(line for text in found for line in text.split("\n") if line)
    assert lines == sorted({line for t in docs.collect() for line in t["text"].split("\n")})
    assert "line number one, long" in "\n".join(found) and len(found) == 6
    assert [r["text"] for r in line_dedup(docs.where("doc_id = 2")).collect()] == ["gamma line, long enough"]
