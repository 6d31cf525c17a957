from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anbar.llm.bpe import UNUSUAL, Bpe, decode, encode, op12_bpe
from anbar.llm.packing import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bpe():
    return Bpe(vocabulary())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def made(rng):
    kind = rng.randrange(4)
    if kind == 0:
        spans = [(32, 127), (1, 0x300), (0x300, 0x3000), (0x4E00, 0x5000), (0x10000, 0x1FFFF)]
        return "".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(40)))
    if kind == 1:
        parts = ["'s", "'LL", " ", "  ", "\n", "\t", "a", "é", "1", "١", "²", "!", "_", "<|endoftext|>", "\xa0", "\x1c"]
        return "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
    if kind == 2:
        return rng.choice("ab !1é") * rng.randrange(300)
    return "".join(rng.choice("aeinorst") for _ in range(rng.randrange(400)))


def test_equal_to_the_library(bpe, tokenizer):
    rng = random.Random(1)
    texts = [made(rng) for _ in range(6000)]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 50):
        assert [i.tolist() for i in bpe.encode(texts[at : at + 50])] == expected[at : at + 50]
    for ids in expected:
        assert bpe.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_texts_cut_at_spaces_equal_the_library(bpe, tokenizer):
    rng = random.Random(5)
    parts = [" ", " ", " ", "  ", "   ", "\n", "\n\n", " \n", "\t", "\xa0", "\u3000", "\u2003", "\x85", "a", "bc.", "it's", "12", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in bpe.encode(texts)] == expected


def test_equal_pieces_are_looked_up_once(monkeypatch):
    bpe, looked_up = Bpe(vocabulary()), []

    class Counted(dict):
        def get(self, piece):
            looked_up.append(piece)
            return super().get(piece)

    bpe.known = Counted()
    bpe.encode(["again and again, again and again"] * 50)
    assert len(looked_up) == len(set(looked_up))


def test_pairs_of_bytes_are_not_searched_for(monkeypatch):
    bpe, asked = Bpe(vocabulary()), []
    ranks = bpe._ranks
    monkeypatch.setattr(bpe, "_ranks", lambda left, right: asked.append(len(left)) or ranks(left, right))
    rng = random.Random(3)
    words = list({"".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 40))) for _ in range(500)})
    ids = bpe.encode_pieces(words)
    merges = sum(map(len, words)) - sum(map(len, ids)) // 4
    assert sum(asked) == 2 * merges  # a merge makes two new pairs


def test_decode_of_any_ids(bpe, tokenizer):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(len(bpe.bytes_of)) for _ in range(rng.randrange(12))]
        assert bpe.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_usual_characters_are_classed_as_the_library_does(tokenizer):
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(0x10000)):
        if UNUSUAL.match(c) or "\ud800" <= c <= "\udfff":
            continue
        spans = [s for _, s in split(f"a{c}1{c}!{c}")]
        kind = next((k for k, at in (("L", 0), ("N", 2), ("P", 4)) if any(a <= at and at + 2 <= b for a, b in spans)), "S")
        mine = "L" if re.match(r"[^\W\d_]", c) else "N" if re.match(r"\d", c) else "S" if re.match(r"\s", c) else "P"
        assert kind == mine, hex(ord(c))


def test_boundaries_are_in_no_token(bpe):
    inside = {a << 8 | b for raw in bpe.bytes_of[:-1] for a, b in zip(raw, raw[1:], strict=False)}
    assert inside == {p for p in range(1 << 16) if not bpe.forced[p]}


def test_long_fragment_and_full_table(bpe, tokenizer, monkeypatch):
    text = "ab" * 20_000 + "x" * 10_001
    assert bpe.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr("anbar.llm.bpe.TABLE", 3)
    texts = ["one two three four", "two three five", "", "four five six seven one"] * 3
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encode([t])[0].tolist() for t in texts] == expected


def test_edges(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None), (3, "été " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(docs, vocabulary())
    assert out.columns == ["doc_id", "ids"]
    found = sorted((r.doc_id or 0, len(r.ids)) for r in out.collect())
    assert found == [(0, 0), (1, 2), (1, 2), (2, 0), (3, len(Tokenizer.from_file(vocabulary()).encode("été " * 50_000).ids))]
    back = sorted((r.doc_id or 0, r.text) for r in decode(out, vocabulary()).collect())
    assert back == sorted((a or 0, b or "") for a, b, _ in rows)
    assert encode(docs.limit(0), vocabulary()).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode(nothing, vocabulary()).collect()[0].text == ""


def test_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        expected[doc_id] = (len(ids), *digests)
    out = op12_bpe(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == expected


def test_ids_are_decoded_without_an_object_per_token(spark, tokenizer, monkeypatch):
    def refused(self):
        raise AssertionError("lists of ids are read as arrays")

    texts = ["one two", None, "", "été <|endoftext|>", "x" * 999]
    columns = [pa.array([1, 2, 3, 4, 5]), pa.array([tokenizer.encode(t).ids if t is not None else None for t in texts], pa.list_(pa.int32()))]
    given = pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"]).slice(1)
    task = []
    empty = spark.createDataFrame([], "doc_id long, ids array<int>")
    monkeypatch.setattr(type(empty), "mapInArrow", lambda self, f, schema: task.append(f))
    decode(empty, vocabulary())

    class Rows:
        num_columns = 2

        def column(self, i):
            return Column(given.column(1)) if i else given.column(0)

    class Column:
        to_pylist = refused

        def __init__(self, ids):
            self.ids = ids

        def __getattr__(self, name):
            return getattr(self.ids, name)

        def slice(self, *at):
            return Column(self.ids.slice(*at))

    out = next(task[0](iter([Rows()])))
    assert out.column(1).to_pylist() == [t or "" for t in texts[1:]]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Bpe(vocabulary("word_bpe_49k.json"))


def test_column_names(spark):
    docs = spark.createDataFrame([(7, "hi", "k")], "n long, body string, kind string")
    out = encode(docs, vocabulary(), "n", "body", keep=["kind"])
    assert decode(out.withColumn("m", F.size("ids")), vocabulary(), "n", text="t", keep=["kind", "m"]).first()[:] == (
        7, "k", 1, "hi",
    )
