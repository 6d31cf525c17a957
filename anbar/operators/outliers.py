"""Winsorised quantities per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.functions.numbers import half_even
from anbar.operators.joins import join_counted
from anbar.operators.prefix import exact_quantiles
from anbar.plans.session import stored

QUARTILES = (0.25, 0.75)
FENCE_PLACES = 9


def log_quantity(qty: Column) -> Column:
    return F.log1p(F.greatest(qty, F.lit(0.0)))


def _fences(q: Column, cfg: Config) -> tuple[Column, Column]:
    reach = (q[1] - q[0]) * F.lit(cfg.winsor_fence)
    return q[0] - reach, q[1] + reach


def quantity_bounds(df: DataFrame, cfg: Config, weight: Column | None = None) -> DataFrame:
    """(product_code, n, low, high): fences of log1p(quantity) per product.

    Products with fewer than ``winsor_min_rows`` rows take the fences of all rows, and so do
    the rows without a product code, which count in those fences and get a row of their own.
    ``weight`` is the number of transactions a row of ``df`` stands for.
    """
    weight = F.lit(1) if weight is None else weight
    counted = (
        df.groupBy("product_code", F.greatest("qty", F.lit(0.0)).alias("__qty"))
        .agg(F.sum(weight).alias("__count"))
        .select("product_code", log_quantity(F.col("__qty")).alias("log_qty"), "__count")
    )
    counted = stored(counted, "product_code")
    coded = counted.where(F.col("product_code").isNotNull())
    own = exact_quantiles(coded, ["product_code"], "log_qty", "__count", QUARTILES)
    uncoded = counted.where(F.col("product_code").isNull()).groupBy("product_code")
    nothing = F.lit(None).cast("array<double>").alias("q")
    own = own.unionByName(uncoded.agg(F.sum("__count").alias("n"), nothing))
    own = stored(own, "product_code")
    q = F.col("q")
    few = (F.col("n") < cfg.winsor_min_rows) | F.col("product_code").isNull()
    if not own.where(few).isEmpty():
        everything = counted.groupBy("log_qty").agg(F.sum("__count").alias("__count"))
        overall = exact_quantiles(everything, [], "log_qty", "__count", QUARTILES).first()["q"]
        q = F.when(few, F.array(*[F.lit(v) for v in overall])).otherwise(q)
    low, high = _fences(q, cfg)
    return own.select("product_code", "n", low.alias("low"), high.alias("high"))


def clipped_quantity(qty: Column, low: Column, high: Column) -> Column:
    """Whole quantity, BIGINT. Only clipped rows go through exp: unclipped ones are rounded as
    they are, and a fence is rounded to 9 places first, so log/exp noise cannot flip a half."""
    log_qty = log_quantity(qty)
    value = (
        F.when(log_qty < low, half_even(F.expm1(low), FENCE_PLACES))
        .when(log_qty > high, half_even(F.expm1(high), FENCE_PLACES))
        .otherwise(F.greatest(qty, F.lit(0.0)))
    )
    return F.greatest(F.rint(value), F.lit(0.0)).cast("bigint")


def apply_bounds(df: DataFrame, bounds: DataFrame, cfg: Config) -> DataFrame:
    """``original_qty`` keeps the quantity, ``qty`` becomes the winsorised one.

    Rows without a product code get the fences of all rows.
    """
    return clipped(join_counted(df, bounds, ["product_code"], "n", cfg), bounds)


def clipped(joined: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with their fences ``low`` and ``high`` to winsorised rows, see ``apply_bounds``."""
    uncoded = bounds.where(F.col("product_code").isNull()).first()
    if uncoded is not None:
        joined = joined.withColumns(
            {c: F.when(F.col("product_code").isNull(), F.lit(uncoded[c])).otherwise(F.col(c))
             for c in ("low", "high")}
        )
    return joined.withColumns(
        {
            "original_qty": F.col("qty"),
            "qty": F.when(
                F.col("low").isNotNull(),
                clipped_quantity(F.col("qty"), F.col("low"), F.col("high")),
            ),
        }
    ).drop("low", "high")


def winsorize(df: DataFrame, cfg: Config) -> DataFrame:
    return apply_bounds(df, quantity_bounds(df, cfg), cfg)
