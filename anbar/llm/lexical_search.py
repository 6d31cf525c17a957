"""Ranked lexical search: accumulators for short lists, document-at-a-time skipping over long ones.

The documents are dealt into shards of bounded size, each with an inverted index of the terms
that the items ask for. The index is written; document frequencies and lengths over all
documents follow from it, and then every shard answers every item:

* The shortest lists of an item are summed term at a time into accumulators. From then on these
  are one more iterator over documents, with bounds of its own.
* The accumulators and the long lists are walked together in the order of documents, some blocks
  of documents at a time. Every iterator knows the largest score it has in each block. Blocks
  whose bounds do not add up to the score of the last result so far are skipped, and within a
  block only the iterators with the largest bounds propose documents; the others are looked up
  for those documents alone, until their bounds cannot lift them any more.

The results of a task are the best of all its shards; the best of all tasks are chosen by Spark.
Skipping is exact: a bound equal to the last score is followed, since ties go by document.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.llm.common import table, written

#: A term is a run of letters, digits and characters beyond ASCII; only A-Z are lower-cased.
LETTERS = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
#: Bytes of texts and number of documents from which on a shard is closed.
SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 15
#: Shards that a task answers: the best documents of one bound those of the next.
TASK_SHARDS = 4
#: Items are answered in blocks of about this many characters.
BLOCK_CHARS = 4 << 20
#: Documents of a block of bounds, and blocks that are scored together.
BLOCK_DOCS = 64
BLOCKS = 8
#: The short lists of an item together have at most one posting for so many documents.
SHORT_SHARE = 4


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


# --- shards -----------------------------------------------------------------

SHARD = T.StructType([
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_terms", T.LongType()),
    T.StructField("terms", T.ArrayType(T.IntegerType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("lengths", T.BinaryType()),
    T.StructField("places", T.BinaryType()),
    T.StructField("counts", T.BinaryType()),
])


def shards(docs: DataFrame, vocabulary: Mapping[bytes, int], key: str, text: str) -> DataFrame:
    """Index rows of bounded size: ``keys`` and the fields of ``SHARD``.

    ``vocabulary`` numbers the terms from 1. ``places`` holds for each of the ``terms`` the
    documents with it, in order, and ``counts`` how often. Documents without terms are left out.
    """
    key_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(key_type)), *SHARD])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        keys: list[pa.Array] = []
        lengths, ids, ends = array("q"), array("i"), array("q")
        size = 0

        def closed() -> pa.RecordBatch:
            n = len(lengths)
            of_doc = np.repeat(np.arange(n), np.diff(np.array(ends), prepend=0))
            pairs, counts = np.unique(np.array(ids, np.int64) * n + of_doc, return_counts=True)
            terms, firsts = np.unique(pairs // n, return_index=True)
            sizes = np.diff(firsts, append=len(pairs))
            flat = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), flat),
                    pa.array([n], pa.int64()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([terms.tolist()], pa.list_(pa.int32())),
                    pa.array([sizes.tolist()], pa.list_(pa.int32())),
                    pa.array([lengths.tobytes()], pa.binary()),
                    pa.array([(pairs % n).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
                ],
                names=schema.names,
            )

        for batch in batches:
            column = batch.column(1)
            held: list[int] = []
            for i in range(len(column)):
                words = terms_of(column[i].as_py())
                if words:
                    held.append(i)
                    lengths.append(len(words))
                    ids.extend(filter(None, map(get, words)))
                    ends.append(len(ids))
                    size += sum(map(len, words)) + len(words)
                if size >= SHARD_BYTES or len(lengths) >= SHARD_DOCS:
                    keys.append(batch.column(0).take(pa.array(held, pa.int64())))
                    yield closed()
                    keys, held, size = [], [], 0
                    lengths, ids, ends = array("q"), array("i"), array("q")
            if held:
                keys.append(batch.column(0).take(pa.array(held, pa.int64())))
        if lengths:
            yield closed()

    return docs.select(docs[key], docs[text].cast("binary")).mapInArrow(indexed, schema)


# --- search in a shard ------------------------------------------------------


class Postings(NamedTuple):
    """An iterator over documents: places in order, scores, and the largest score by block."""

    places: np.ndarray
    scores: np.ndarray
    bounds: np.ndarray


def block_bounds(places: np.ndarray, scores: np.ndarray, blocks: int) -> np.ndarray:
    out = np.zeros(blocks, np.int64)
    block = places // BLOCK_DOCS
    firsts = np.flatnonzero(np.diff(block, prepend=-1))
    out[block[firsts]] = np.maximum.reduceat(scores, firsts)
    return out


def accumulated(lists: Sequence[Postings], blocks: int) -> Postings:
    """Short lists summed term at a time, as one iterator."""
    places = np.concatenate([x.places for x in lists])
    scores = np.concatenate([x.scores for x in lists])
    order = np.argsort(places, kind="stable")
    places, scores = places[order], scores[order]
    firsts = np.flatnonzero(np.diff(places, prepend=-1))
    places, scores = places[firsts], np.add.reduceat(scores, firsts)
    return Postings(places, scores, block_bounds(places, scores, blocks))


def _scored(
    lists: Sequence[Postings], first: int, last: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the blocks first .. last - 1 with a score of ``least`` or more."""
    low, high = first * BLOCK_DOCS, last * BLOCK_DOCS
    bounds = np.array([x.bounds[first:last].max() for x in lists])
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    # rest[i]: what the iterators from the i-th on can add.
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    proposing = int((rest[:-1] >= least).sum())
    score = np.zeros(high - low, np.int64)
    for i in order[:proposing]:
        places = lists[i].places
        a, b = np.searchsorted(places, (low, high))
        score[places[a:b] - low] += lists[i].scores[a:b]
    docs = np.flatnonzero(score)
    for i, more in zip(order[proposing:], rest[proposing:], strict=False):
        docs = docs[score[docs] + more >= least]
        if not len(docs):
            break
        places = lists[i].places
        at = np.minimum(np.searchsorted(places, docs + low), len(places) - 1)
        hit = places[at] == docs + low
        score[docs[hit]] += lists[i].scores[at[hit]]
    docs = docs[score[docs] >= least]
    return docs + low, score[docs]


class Best:
    """The k best (score, key) so far: highest score first, then smallest key, null keys last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[tuple[int, bool, object]] = []

    @property
    def least(self) -> int:
        """The score a further result needs."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ranks: np.ndarray, docs: np.ndarray, keys: list) -> None:
        for i in np.lexsort((ranks[docs], -scores))[: self.k]:
            key = keys[docs[i]]
            self.rows.append((-int(scores[i]), key is None, 0 if key is None else key))
        self.rows.sort()
        del self.rows[self.k :]


class Shard:
    """One row of the index, with the scores of its postings."""

    def __init__(self, row: Mapping, weights: np.ndarray, docs: int, words: int) -> None:
        self.keys = row["keys"]
        n = len(self.keys)
        self.blocks = -(-n // BLOCK_DOCS)
        order = sorted(range(n), key=lambda i: (self.keys[i] is None, 0 if self.keys[i] is None else self.keys[i]))
        self.ranks = np.empty(n, np.int64)
        self.ranks[order] = np.arange(n)
        lengths = np.frombuffer(row["lengths"], np.int64).tolist()
        m = np.array([75 + 25 * x * docs // words for x in lengths], np.int64)
        places = np.frombuffer(row["places"], np.int32)
        counts = np.frombuffer(row["counts"], np.int64)
        terms, sizes = np.array(row["terms"], np.int64), np.array(row["sizes"], np.int64)
        scores = 1_000_000_000 * counts // (1000 * counts + 12 * m[places]) * np.repeat(weights[terms], sizes)
        self.lists: dict[int, Postings] = {}
        end = 0
        for term, size in zip(terms.tolist(), sizes.tolist(), strict=True):
            start, end = end, end + size
            mine = places[start:end], scores[start:end]
            self.lists[term] = Postings(*mine, block_bounds(*mine, self.blocks))

    def search(self, query: Sequence[tuple[int, int]], best: Best) -> None:
        """Adds the best documents for (term, repeats) pairs."""
        lists = []
        for term, repeats in query:
            if (found := self.lists.get(term)) is not None:
                if repeats > 1:
                    found = Postings(found.places, found.scores * repeats, found.bounds * repeats)
                lists.append(found)
        lists.sort(key=lambda x: len(x.places))
        short = int(np.searchsorted(np.cumsum([len(x.places) for x in lists]), len(self.keys) / SHORT_SHARE))
        if short > 1:
            lists = [accumulated(lists[:short], self.blocks), *lists[short:]]
        if not lists:
            return
        bound = np.sum([x.bounds for x in lists], axis=0)
        at = 0
        while at < self.blocks:
            ahead = np.flatnonzero(bound[at:] >= best.least)
            if not len(ahead):
                return
            first = at + int(ahead[0])
            gap = np.flatnonzero(np.diff(ahead[:BLOCKS]) > 1)
            last = first + (int(gap[0]) + 1 if len(gap) else len(ahead[:BLOCKS]))
            docs, scores = _scored(lists, first, last, best.least)
            if len(docs):
                best.add(scores, self.ranks, docs, self.keys)
            at = last


def _searched(
    index: DataFrame, queries: Sequence[tuple[int, list[tuple[int, int]]]], weights: np.ndarray,
    docs: int, words: int, k: int, key: str,
) -> DataFrame:
    """(item, key, score): the ``k`` best of each task's shards for each item."""
    schema = T.StructType([
        T.StructField("item", T.LongType()),
        T.StructField(key, index.schema["keys"].dataType.elementType),
        T.StructField("score", T.LongType()),
    ])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        kind = None
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], weights, docs, words)
                for (_, query), mine in zip(queries, best, strict=True):
                    shard.search(query, mine)
        if kind is not None:
            rows = [
                (item, None if null else found, -negative)
                for (item, _), mine in zip(queries, best, strict=True)
                for negative, null, found in mine.rows
            ]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return index.mapInArrow(answered, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_key, rank, key, score): the ``k`` documents with the highest scores for each item.

    Every row of ``items`` is a question of its own and every row of ``docs`` a result of its own,
    also where keys repeat or are null (null keys come last among equal scores). Texts that are
    null or hold no term match nothing, and neither do items without a known term; empty tables
    give no rows.
    """
    spark = docs.sparkSession
    asked = written(
        items.select(items[item_key].alias("key"), items[item_text].alias("text")).withColumn(
            "item", F.monotonically_increasing_id()
        )
    )
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    answers = None
    for i in range(blocks):
        texts = asked.where(block == i).select("item", F.col("text").cast("binary").alias("text")).collect()
        words = {r["item"]: Counter(terms_of(r["text"])) for r in texts}
        terms = {t: j for j, t in enumerate(sorted(set().union(*words.values())), 1)}
        index = written(shards(docs, terms, key, text))
        sums = (F.count("*").alias("shards"), F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("words"))
        total = index.agg(*sums).first()
        if not total["docs"]:
            break
        # One count per term of the items, of which a block has a bounded number.
        held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select("x.*")
        weights = np.zeros(len(terms) + 1, np.int64)
        for row in held.groupBy("terms").agg(F.sum("sizes").alias("df")).collect():
            weights[row["terms"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * row["df"] + 1)))
        queries = [
            (item, [(terms[t], n) for t, n in found.items() if weights[terms[t]]]) for item, found in words.items()
        ]
        dealt = index.repartition(-(-total["shards"] // TASK_SHARDS))  # compact rows, but long work
        mine = written(_searched(dealt, queries, weights, total["docs"], total["words"], k, "found"))
        answers = mine if answers is None else answers.unionByName(mine)
    if answers is None:
        kind = docs.schema[key].dataType.simpleString()
        answers = spark.createDataFrame([], f"item long, found {kind}, score long")
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    ranked = answers.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "key"), "item").select(
        F.col("key").alias(item_key), "rank", F.col("found").alias(key), "score"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS place, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), items AS (
    SELECT row_number() OVER () AS item, item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM benchmark
), sizes AS (
    SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0
), asked AS (
    SELECT item, term, count(*) AS repeats
    FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY item, term
), postings AS (
    SELECT place, term, count(*) AS tf
    FROM (SELECT place, unnest(terms) AS term FROM docs) GROUP BY place, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE)
        / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, sizes GROUP BY term
), scored AS (
    SELECT a.item, d.doc_id, d.place, CAST(sum(a.repeats * w.w * ((1000000000 * p.tf)
        // (1000 * p.tf + 12 * (100 - 25 + ((25 * len(d.terms) * n_docs) // n_terms))))) AS BIGINT) AS score
    FROM asked a JOIN weights w USING (term) JOIN postings p USING (term) JOIN docs d USING (place), sizes
    GROUP BY a.item, d.doc_id, d.place
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 20
"""
