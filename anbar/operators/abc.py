"""Monthly ABC (Pareto) classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anbar.config import ABC_CODES, ABC_EXPORT_COLUMNS, Config
from anbar.functions.numbers import half_even
from anbar.operators.joins import join_counted
from anbar.operators.outliers import winsorize
from anbar.operators.prefix import running_totals
from anbar.plans.session import stored

ABC_COLUMNS = ("month_qty", "month_txn_count", "month_rank", "share_pct", "cum_pct", "abc_class")


def monthly_consumption(
    df: DataFrame, qty: Column | None = None, weight: Column | None = None
) -> DataFrame:
    """Quantity and transaction count per (Jalali month, product)."""
    qty = F.col("qty") if qty is None else qty
    weight = F.lit(1) if weight is None else weight
    return (
        df.na.drop(subset=["jalali_month", "product_code"])
        .groupBy("jalali_month", "product_code")
        .agg(F.sum(qty).alias("month_qty"), F.sum(weight).alias("month_txn_count"))
    )


def classify(monthly: DataFrame, cfg: Config) -> DataFrame:
    """Rank, shares and class of each product within its month.

    An item is A while the items before it hold less than 70 % of the month, so the one
    that crosses the line is still A. Compared in whole numbers: no float edge decides.
    """
    ranked = running_totals(
        monthly,
        ["jalali_month"],
        [-F.col("month_qty"), F.col("product_code")],
        {"qty": F.col("month_qty"), "rank": F.lit(1)},
    )
    total, running = F.col("total_qty"), F.col("run_qty")
    before = (running - F.col("month_qty")) * 100
    abc_class = (
        F.when(total <= 0, "C")
        .when(before < total * cfg.a_threshold, "A")
        .when(before < total * cfg.b_threshold, "B")
        .otherwise("C")
    )

    def percent(part: Column) -> Column:
        return F.when(total > 0, half_even(part / total * 100, 2)).otherwise(0.0)

    return ranked.select(
        "jalali_month",
        "product_code",
        "month_qty",
        "month_txn_count",
        F.col("run_rank").cast("int").alias("month_rank"),
        percent(F.col("month_qty")).alias("share_pct"),
        percent(running).alias("cum_pct"),
        abc_class.alias("abc_class"),
    )


def monthly_abc(df: DataFrame, cfg: Config) -> DataFrame:
    return classify(monthly_consumption(df), cfg)


def add_abc(df: DataFrame, abc: DataFrame, cfg: Config) -> DataFrame:
    """Back-join the classes to the transactions."""
    lookup = abc.withColumn("__rows", F.col("month_txn_count"))
    return join_counted(df, lookup, ["jalali_month", "product_code"], "__rows", cfg)


def enrich(prepared: DataFrame, cfg: Config) -> DataFrame:
    """Prepared transactions with winsorised quantity and ABC columns."""
    treated = winsorize(prepared, cfg)
    abc = stored(monthly_abc(treated, cfg), "product_code")
    return add_abc(treated, abc, cfg)


def abc_export(enriched: DataFrame) -> DataFrame:
    """Distinct ABC rows, with the key columns that exist. A Jalali month touching two
    Gregorian months gives two rows per product."""
    return enriched.select(*[c for c in ABC_EXPORT_COLUMNS if c in enriched.columns]).distinct()


def abc_sheet(months: DataFrame, abc: DataFrame) -> DataFrame:
    """The same rows from (jalali_month, month_start, product_code), without another read of
    the transactions. Both sides have a key at most twice, so none is hot."""
    rows = months.join(abc, ["jalali_month", "product_code"])
    return rows.select(*[c for c in ABC_EXPORT_COLUMNS if c in rows.columns])


def class_code(abc_class: Column) -> Column:
    code = None
    for name, value in ABC_CODES.items():
        hit = abc_class == name
        code = F.when(hit, value) if code is None else code.when(hit, value)
    return code
