"""Lookup joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anbar.config import Config


class Size(NamedTuple):
    """What is known of a lookup: its rows, the left rows they stand for, and its bytes."""

    rows: int
    total: int
    bytes: int


def size_of(lookup: DataFrame, count: str) -> Size:
    """One job. Texts count with their length, other columns with 16 bytes."""
    widths = [
        F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(16)
        for c, t in lookup.dtypes
    ]
    row = lookup.agg(
        F.count("*").alias("rows"), F.sum(count).alias("total"),
        F.sum(sum(widths, F.lit(16))).alias("bytes"),
    ).first()
    return Size(row["rows"], row["total"] or 0, row["bytes"] or 0)


def fits_broadcast(size: Size, cfg: Config) -> bool:
    return size.rows <= cfg.broadcast_rows and size.bytes <= cfg.broadcast_bytes


def join_counted(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    count: str,
    cfg: Config,
    size: Size | None = None,
) -> DataFrame:
    """Left join to a lookup whose ``count`` says how many left rows each key has.

    * up to ``cfg.broadcast_rows`` rows and ``cfg.broadcast_bytes`` bytes: the lookup is
      broadcast, after measuring it (or with the ``size`` the caller knows);
    * beyond: hot keys (see ``Config.hot_per_partition``; fewer than that times the shuffle
      partitions) are broadcast, the other rows are joined by shuffle. Rows of hot keys, and
      rows whose key is null, travel that shuffle under a spread null key, so no task receives
      a whole hot key.

    ``right`` has unique keys and should be cheap to read twice; ``count`` is dropped.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys and c != count]
    size = size or size_of(right, count)
    lookup = right.select(*keys, *values)
    if fits_broadcast(size, cfg):
        return left.join(F.broadcast(lookup), keys, "left").select(*left.columns, *values)

    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(count) > F.lit(size.total / (cfg.hot_per_partition * partitions))
    hot = right.where(is_hot).select(
        *keys, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot")
    )
    cold = right.where(~is_hot).select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], *values, F.lit(0).alias("__spread")
    )
    marked = left.join(F.broadcast(hot), keys, "left")
    settled = F.col("__hot").isNotNull()
    for k in keys:
        settled = settled | F.col(k).isNull()
    # Repeatable on a retried task, and copies of one row still differ by input partition.
    spread = 4 * partitions
    mixed = F.xxhash64(F.spark_partition_id(), *left.columns)
    row_hash = F.pmod(mixed, F.lit(spread)).cast("int") + 1
    marked = marked.withColumns(
        {f"__key_{k}": F.when(~settled, F.col(k)) for k in keys}
        | {"__spread": F.when(settled, row_hash).otherwise(0)}
    )
    joined = marked.join(cold, [*[f"__key_{k}" for k in keys], "__spread"], "left")
    return joined.select(
        *left.columns, *[F.coalesce(f"__hot_{v}", v).alias(v) for v in values]
    )
