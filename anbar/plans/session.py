"""Shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="anbar-checkpoint-", dir="/tmp")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a small ``df`` to the shared folder and go on from the written rows, in their order.

    Large frames go through ``stored``: a checkpoint is neither compressed nor read by column.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside gives its shuffle files back when it has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, key: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the written rows.

    Used where a frame feeds several jobs that must see the very same rows or where recomputing
    would read the transactions again. With ``key`` the rows are dealt into as many buckets as
    there are shuffle partitions, so what groups or joins by ``key`` later needs no exchange.
    Rows may come back in another order.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}"
    with shuffles_removed(spark):
        if key is None:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartition(buckets, key).write.bucketBy(buckets, key)
        dealt.option("compression", "zstd").option("path", path).saveAsTable(f"anbar_{name}", format="parquet")
    # Without the table's name on its columns, a union of such frames stays dealt by ``key``.
    return spark.table(f"anbar_{name}").select(*[F.col(c).alias(c) for c in df.columns])
