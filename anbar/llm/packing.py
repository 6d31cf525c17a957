"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing takes the pieces by falling length and puts each into the open sequence
with the least room that is enough. Where a piece goes depends on lengths only, and there are
no more lengths than tokens in a sequence. So the exact algorithm runs on the histogram of
lengths, whose size does not grow with the corpus: a segment tree over remaining capacities
finds the tightest open sequence in logarithmic time, and equal pieces that go to equal
sequences move together as a run. Pieces are numbered within their length on the cluster and
look their sequence up in the runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.llm.bpe import loaded as token_ids
from anbar.llm.common import short_reads, table, text_batches, vocabulary, written

LENGTH = 2048
#: Rows of counts (tasks x lengths) up to which they are broadcast to the pieces.
BROADCAST_ROWS = 500_000

# --- the packing plan -------------------------------------------------------


class Tree:
    """Segment tree over capacities 0 .. size: the smallest open capacity from a place on."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, open_: bool) -> None:
        node = self.leaves + capacity
        self.open[node] = open_
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:  # up until there is an open capacity to the right, then down to the first
            if not node % 2 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


class Run(NamedTuple):
    """Pieces ``rank`` .. ``rank + count - 1`` of a length go ``each`` to a sequence, from
    ``sequence`` on, beginning at ``offset`` of it."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: Mapping[int, int], size: int = LENGTH) -> list[Run]:
    """Best-fit decreasing of ``histogram`` (pieces by length, 1 .. size) into ``size``."""
    tree, stock = Tree(size), {}  # stock: capacity -> [(first sequence, how many)]
    sequences, runs = 0, []

    def store(capacity: int, first: int, many: int) -> None:
        if capacity and many:
            if not stock.get(capacity):
                tree.set(capacity, True)
            stock.setdefault(capacity, []).append((first, many))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, many = size, sequences, -(-left // (size // length))
                sequences += many
            else:
                first, many = stock[capacity].pop()
                if not stock[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            whole = min(many, left // each)  # sequences that take all they can
            if whole:
                runs.append(Run(length, rank, whole * each, first, each, size - capacity))
                rank, left = rank + whole * each, left - whole * each
                store(capacity - each * length, first, whole)
                first, many = first + whole, many - whole
            if many and left < each:
                if left:
                    runs.append(Run(length, rank, left, first, left, size - capacity))
                    store(capacity - left * length, first, 1)
                    first, many, rank, left = first + 1, many - 1, rank + left, 0
                store(capacity, first, many)
    return runs


# --- on the cluster ---------------------------------------------------------

FIELDS = "piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = LENGTH,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokens of every document plus id 0, cut into pieces of at most ``size`` tokens.

    Only longer documents are cut, and only their first piece may be shorter. ``rank`` numbers
    the pieces of a length within the task ``part`` that made them. Null text counts as empty.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(FIELDS)])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of, seen = token_ids(tokenizer), [0] * (size + 1)
        end = np.zeros(1, "<u4")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            at: list[int] = []
            kept: list[np.ndarray] = []
            for i, found in enumerate(ids_of.of_each(texts)):
                ids = np.concatenate([found, end])
                n = len(ids)
                stop = n - (-(-n // size) - 1) * size  # the end of the first piece
                start = piece = 0
                while start < n:
                    mine = ids[start:stop]
                    length = stop - start
                    rows.append((piece, start, length, zlib.crc32(mine.tobytes()), part, seen[length]))
                    seen[length] += 1
                    at.append(i)
                    if keep_ids:
                        kept.append(mine.astype("<i4"))
                    start, stop, piece = stop, stop + size, piece + 1
            if not rows:
                continue
            columns = [pa.array(c, f) for c, f in zip(
                zip(*rows, strict=True),
                (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            columns = [batch.column(0).take(pa.array(at)), *columns]
            if keep_ids:
                offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        pa.default_memory_pool().release_unused()

    return text_batches(docs).select(docs[key], docs[text]).mapInArrow(cut, schema)


def place(cut: DataFrame, size: int = LENGTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written ``pieces``."""
    # Counted twice, from two columns: a written table of counts is a file per shuffle partition.
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
    histogram = {r["length"]: r["n"] for r in by_length}
    runs = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if sum(r["parts"] for r in by_length) <= broadcast_rows:
        bases = F.broadcast(bases)
    numbered = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    numbered = numbered.drop("base", "part")
    table_of_runs = np.array(sorted(runs) or [Run(0, 0, 0, 0, 1, 0)], dtype=np.int64)
    # Length and rank as one number: ranks of a length are below the widest histogram entry.
    span = max(histogram.values(), default=0) + 1
    starts = table_of_runs[:, 0] * span + table_of_runs[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = table_of_runs[np.searchsorted(starts, length * span + rank, side="right") - 1]
            local = rank - run[:, 1]
            sequence = run[:, 3] + local // run[:, 4]
            offset = run[:, 5] + local % run[:, 4] * length
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    schema = T.StructType([f for f in numbered.schema if f.name != "rank"])
    schema = schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(put, schema)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = LENGTH,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    Repeated rows are packed as often as they occur; an empty table gives no rows. Sequence ids
    run from 0 without gaps; pieces fill a sequence without gaps from offset 0.
    """
    with short_reads(docs.sparkSession):
        cut = written(pieces(docs, tokenizer, key, text, size, keep_ids))
    return place(cut, size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a packing with kept ids; a sequence is bounded by its size."""
    rows = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows")
    )
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
