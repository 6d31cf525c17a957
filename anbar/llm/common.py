"""Tables, written intermediate results and text expressions shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.plans.session import ensure_checkpoint_dir

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed
#: and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The bytes at which a batch of rows for Python ends.
BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: The rows of a batch of the Parquet reader, which holds their texts in one array that doubles as it grows.
READ_SIZE = "spark.sql.parquet.columnarReaderBatchSize"
READ_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the file.

    Unlike a checkpoint the file is compressed and is read by column. It cuts the lineage,
    so a lost executor costs only a new read.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose Arrow batches end at BATCH_BYTES unless the session names another size.

    Batches are bounded by rows only otherwise, and long texts fill the memory of the executor
    and of its Python workers, which stay with what they once took.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SIZE, None) is None:
        conf.set(BATCH_SIZE, str(BATCH_BYTES))
    return df


@contextmanager
def short_reads(spark: SparkSession) -> Iterator[None]:
    """Jobs inside read Parquet by READ_ROWS rows, unless the session names another number.

    With the usual 4096 the arrays of texts are so large that each is laid out by itself in the
    heap, which grows with them.
    """
    named = spark.conf.get(READ_SIZE, None) is not None
    if not named:
        spark.conf.set(READ_SIZE, str(READ_ROWS))
    try:
        yield
    finally:
        if not named:
            spark.conf.unset(READ_SIZE)


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


ARROW = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
    T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
}


def arrow_batch(columns: list, fields: T.StructType) -> pa.RecordBatch:
    """A record batch of Python sequences or arrays, one per field."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, ARROW[type(f.dataType)])
        for c, f in zip(columns, fields, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=fields.names)


def per_text(
    docs: DataFrame,
    key: str,
    text: str,
    fields: str,
    rows: Callable[[list[str | None]], Iterable[tuple]],
    also: Sequence[str] = (),
) -> DataFrame:
    """The key, the columns ``also`` and ``fields`` of each document; ``rows`` maps texts to
    tuples, in order.

    The key and ``also`` stay Arrow columns, so null and large ids pass unchanged.
    """
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([docs.schema[key], *[docs.schema[c] for c in also], *made])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(rows(batch.column(1).to_pylist()))
            columns = list(zip(*done, strict=True)) if done else [[] for _ in made]
            passed = [c for i, c in enumerate(batch.columns) if i != 1]
            arrays = passed + list(arrow_batch([list(c) for c in columns], made).columns)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return text_batches(docs).select(docs[key], docs[text], *[docs[c] for c in also]).mapInArrow(mapped, schema)


def task_sums(
    rows: DataFrame,
    vector: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
    size: int,
    block: int = 4096,
    fan_in: int = 64,
) -> np.ndarray:
    """Sum over all tasks of ``vector(batches of the task)``, ``size`` float64 values.

    A task gives its vector away in blocks, and the blocks are added in groups of at most
    ``fan_in`` tasks, level by level. Only the sum, whose size is fixed, reaches the driver.
    """
    blocks = -(-size // block)
    schema = "block int, part long, data binary"

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine = np.zeros(blocks * block)
        mine[:size] = vector(batches)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(blocks), pa.int32()),
                pa.array([part] * blocks, pa.int64()),
                pa.array([x.tobytes() for x in mine.reshape(blocks, block)], pa.binary()),
            ],
            names=["block", "part", "data"],
        )

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(block)
        # A fixed order of the summands makes reruns agree.
        for value in group.sort_by("part")["data"]:
            total += np.frombuffer(value.as_buffer())
        return pa.table(
            {
                "block": pa.array([group["block"][0].as_py()], pa.int32()),
                "part": pa.array([group["next"][0].as_py()], pa.int64()),
                "data": pa.array([total.tobytes()], pa.binary()),
            }
        )

    level = written(text_batches(rows).mapInArrow(given, schema))
    while level.count() > blocks:
        level = level.withColumn("next", F.floor(F.col("part") / fan_in).cast("long"))
        level = written(level.groupBy("block", "next").applyInArrow(added, schema))
    out = np.zeros(blocks * block)
    for row in level.collect():
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["data"])
    return out[:size]
