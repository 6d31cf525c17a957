"""Running totals and exact quantiles over groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anbar.functions.numbers import int_div
BLOCK = "__block"
#: A group with more rows than this is worked on in blocks of about so many rows.
BLOCK_ROWS = 1_000_000
#: Sampled rows per block, from which its border is taken.
SAMPLES = 8
#: Borders are looked up in two steps: among every so many, then among those in between.
STRIDE = 256


def _looked_up(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the other columns of ``small``, which is broadcast; null keys are equal."""
    small = small.withColumnsRenamed({c: f"__key_{c}" for c in keys})
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return df.join(F.broadcast(small), match, how).drop(*[f"__key_{c}" for c in keys])


def _block_borders(
    df: DataFrame, group: list[str], order: Sequence[Column], key: Column, block_rows: int
) -> DataFrame | None:
    """(group, __borders, __coarse) of the groups with more than ``block_rows`` rows, if any.

    The borders are fixed values, from rows chosen by their hash, so every job that computes a
    block finds the same one. There is one border per ``block_rows`` rows of all groups.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n"))
    large = sizes.where(F.col("__n") > block_rows).drop("__n")
    if large.isEmpty():
        return None
    step = max(1, block_rows // SAMPLES)
    chosen = df.where(F.pmod(F.xxhash64(*group, *order), F.lit(step)) == 0)
    chosen = _looked_up(chosen, large, group, "left_semi")
    sampled = chosen.select(*group, key.alias("key")).groupBy(*group)
    ordered = sampled.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    borders = F.filter("keys", lambda _, i: (i + 1) % SAMPLES == 0)
    return ordered.select(*group, borders.alias("__borders")).withColumn(
        "__coarse", F.filter("__borders", lambda _, i: i % STRIDE == 0)
    )


def _block_of(key: Column) -> Column:
    """The number of borders up to ``key``; 0 without borders."""
    coarse = F.size(F.filter("__coarse", lambda b: b <= key))
    near = F.slice("__borders", (coarse - 1) * STRIDE + 1, F.lit(STRIDE))
    fine = (coarse - 1) * STRIDE + F.size(F.filter(near, lambda b: b <= key))
    return F.when(F.col("__coarse").isNull() | (coarse == 0), 0).otherwise(fine)


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``run_<m>`` (inclusive running total) and ``total_<m>`` per group.

    ``order`` holds ascending values that make the rows of a group unique. The rows cross one
    exchange, on (group, block). A group of up to ``block_rows`` rows is one block; a larger one
    is cut at fixed borders, so a hot group spreads over many tasks. Each block is summed by
    itself and lifted by the totals of the blocks before it: a lookup with one row per block of
    a large group, small enough to broadcast.

    ``df`` is read once more for the sizes of its groups, and again where some are large.
    """
    block_rows = block_rows or BLOCK_ROWS
    columns = df.columns
    if not group:
        df, group = df.withColumn("__all", F.lit(0)), ["__all"]
    group = list(group)
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    borders = _block_borders(df, group, order, key, block_rows)
    if borders is not None:
        df = _looked_up(df, borders, group).withColumn(BLOCK, _block_of(key)).drop("__coarse")
    inside = [*group, BLOCK] if borders is not None else group
    in_block = Window.partitionBy(*inside)
    up_to_here = in_block.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns(
        {f"run_{m}": F.sum(c).over(up_to_here) for m, c in measures.items()}
        | {f"total_{m}": F.sum(c).over(in_block) for m, c in measures.items()}
    )
    results = [f"{kind}_{m}" for kind in ("run", "total") for m in measures]
    if borders is None:
        return local.select(*columns, *results)

    totals = {m: F.sum(c).alias(f"__sum_{m}") for m, c in measures.items()}
    blocks = df.where("__borders is not null").groupBy(*inside).agg(*totals.values())
    whole = Window.partitionBy(*group)
    before = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    lifts = blocks.select(
        *inside,
        *[F.sum(f"__sum_{m}").over(before).alias(f"__lift_{m}") for m in measures],
        *[F.sum(f"__sum_{m}").over(whole).alias(f"__whole_{m}") for m in measures],
    )
    return _looked_up(local, lifts, inside).select(
        *columns,
        *[(F.col(f"run_{m}") + F.coalesce(f"__lift_{m}", F.lit(0))).alias(f"run_{m}") for m in measures],
        *[F.coalesce(f"__whole_{m}", f"total_{m}").alias(f"total_{m}") for m in measures],
    )


def values_at(
    counted: DataFrame,
    group: Sequence[str],
    value: str,
    count: str,
    positions: Sequence[Column],
) -> DataFrame:
    """Per group the values at 0-based sorted positions, as array ``v``, and ``n``.

    ``counted`` holds distinct (group, value) rows with their frequency. Positions are
    BIGINT columns over ``total_n``, the total frequency of the group.
    """
    ranked = running_totals(counted, group, [F.col(value)], {"n": F.col(count)})
    last_position = F.col("run_n") - 1
    first_position = F.col("run_n") - F.col(count)
    found = [
        F.max(F.when(p.between(first_position, last_position), F.col(value))).alias(f"__v{i}")
        for i, p in enumerate(positions)
    ]
    rows = ranked.groupBy(*group).agg(F.max("total_n").alias("n"), *found)
    return rows.select(
        *group, "n", F.array(*[F.col(f"__v{i}") for i in range(len(positions))]).alias("v")
    )


def exact_quantiles(
    counted: DataFrame, group: Sequence[str], value: str, count: str, shares: Sequence[float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact: ``n`` and array ``q``."""

    def place(n: Column, share: float) -> Column:
        return (n - 1) * F.lit(float(share))

    positions = [
        side(place(F.col("total_n"), s)) for s in shares for side in (F.floor, F.ceil)
    ]
    rows = values_at(counted, group, value, count, positions)

    def between(i: int, share: float) -> Column:
        low, high = F.col("v")[2 * i], F.col("v")[2 * i + 1]
        exact = place(F.col("n"), share)
        return low + (high - low) * (exact - F.floor(exact))

    return rows.select(
        *group, "n", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q")
    )


def breakpoints(
    counted: DataFrame, group: Sequence[str], value: str, count: str, parts: int
) -> DataFrame:
    """Inner borders of ``parts`` equally filled bins: the ceil(n*i/parts)-th values."""
    n = F.col("total_n")
    positions = [int_div(n * i + (parts - 1), parts) - 1 for i in range(1, parts)]
    return values_at(counted, group, value, count, positions)


def dense_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, 2 ... in ``order`` without a single-task sort."""
    ranked = running_totals(df, [], order, {"pos": F.lit(1)})
    return ranked.select(*df.columns, (F.col("run_pos") - 1).alias(name))
