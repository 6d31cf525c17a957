"""Dense product x month panel with lag and rolling features."""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.functions import jalali
from anbar.operators.abc import class_code, classify, monthly_consumption
from anbar.operators.outliers import clipped, quantity_bounds
from anbar.plans.session import stored

FACT_COLUMNS = (
    "target", "original_target", "working_day", "month_txn_count",
    "share_pct", "cum_pct", "month_rank", "jalali_year",
)


class Panel(NamedTuple):
    """The panel rows with the month range of their grid."""

    frame: DataFrame
    first: datetime.date
    last: datetime.date

    @property
    def months(self) -> int:
        return (self.last.year - self.first.year) * 12 + self.last.month - self.first.month + 1


class Facts(NamedTuple):
    """Everything the panel needs, at product-month grain."""

    monthly: DataFrame  # (month_start, product_code) sums and maxima
    abc: DataFrame  # (jalali_month, product_code) classes
    products: DataFrame  # product_code, product_name
    bounds: DataFrame  # winsor fences per product
    months: DataFrame  # (jalali_month, month_start, product_code) that have sales
    renamed: DataFrame  # product codes seen under more than one name


def sales_cells(prepared: DataFrame) -> DataFrame:
    """Transactions pre-aggregated by everything winsorising and the panel look at.

    The one pass over the transactions on the modelling path: equal quantities of a
    product in a month collapse map-side, so a hot product shuffles few rows. Rows without
    a product code stay: they count in the fences of all rows.
    """
    columns = prepared.columns
    name = F.col("product_name") if "product_name" in columns else F.lit(None).cast("string")
    working = F.col("working_day") if "working_day" in columns else F.lit(0)
    return (
        prepared.na.drop(subset=["month_start", "jalali_month"])
        .groupBy(
            "product_code", name.alias("product_name"), "month_start", "jalali_month", "qty"
        )
        .agg(
            F.count("*").alias("n"),
            F.sum(working).alias("working_day"),
            F.max("gregorian_date").alias("last_day"),
        )
    )


def product_names(cells: DataFrame) -> DataFrame:
    """One name per code: the one with the latest date, then the greatest text."""
    latest = cells.groupBy("product_code", "product_name").agg(F.max("last_day").alias("day"))
    newest = F.max(F.struct("day", "product_name"))
    return latest.groupBy("product_code").agg(newest.alias("newest")).select(
        "product_code", F.col("newest.product_name").alias("product_name")
    )


def renamed_products(cells: DataFrame) -> DataFrame:
    """Codes seen under more than one name, with the number of names."""
    names = cells.select("product_code", "product_name").distinct()
    counted = names.groupBy("product_code").agg(F.count("*").alias("names"))
    return counted.where(F.col("names") > 1)


def product_month_sums(treated: DataFrame) -> DataFrame:
    """Sums per product, Gregorian and Jalali month of winsorised cells."""
    return treated.groupBy("product_code", "month_start", "jalali_month").agg(
        F.sum(F.col("qty") * F.col("n")).alias("qty"),
        F.sum(F.col("original_qty") * F.col("n")).alias("original_target"),
        F.sum("working_day").alias("working_day"),
        F.sum("n").alias("n"),
    )


def product_month_facts(sums: DataFrame, abc: DataFrame) -> DataFrame:
    """Sums per (month_start, product); ABC columns as the maximum over the one or two
    Jalali months the Gregorian month's sales fall into.

    The classes are stacked below the sums and looked up by a window. With both dealt by
    product nothing crosses an exchange; a join on product and month would move both sides.
    """
    looked_up = ("month_txn_count", "share_pct", "cum_pct", "month_rank")
    stacked = sums.drop("n").unionByName(
        abc.select("jalali_month", "product_code", *looked_up), allowMissingColumns=True
    )
    month = Window.partitionBy("product_code", "jalali_month")
    return (
        stacked.withColumns({c: F.max(c).over(month) for c in looked_up})
        .where(F.col("month_start").isNotNull())
        .groupBy("month_start", "product_code")
        .agg(
            F.sum(F.col("qty").cast("double")).alias("target"),
            *[F.sum(c).alias(c) for c in ("original_target", "working_day")],
            *[F.max(c).alias(c) for c in looked_up],
            F.max(jalali.year_of_key(F.col("jalali_month"))).alias("jalali_year"),
            F.max(jalali.season(jalali.month_of_key(F.col("jalali_month")))).alias(
                "jalali_season"
            ),
        )
    )


def facts(prepared: DataFrame, cfg: Config) -> Facts:
    """Winsorise and classify at cell grain, then sum to product-months.

    Every table is stored in buckets of products. The cells of a product are bounded by its
    months, names and different quantities, so from here on only the ranking within the months
    needs an exchange.
    """
    cells = stored(sales_cells(prepared), "product_code")
    bounds = quantity_bounds(cells, cfg, F.col("n"))
    cells = cells.where(F.col("product_code").isNotNull())
    fences = bounds.drop("n")
    sums = product_month_sums(clipped(cells.join(fences, "product_code", "left"), bounds))
    sums = stored(sums, "product_code")
    consumption = monthly_consumption(sums, F.col("qty"), F.col("n"))
    abc = stored(classify(consumption, cfg), "product_code")
    monthly = stored(product_month_facts(sums, abc), "product_code")
    months = sums.select("jalali_month", "month_start", "product_code")
    names = stored(product_names(cells), "product_code")
    return Facts(monthly, abc, names, bounds, months, renamed_products(cells))


def month_bounds(monthly: DataFrame) -> tuple[datetime.date, datetime.date]:
    first, last = monthly.agg(F.min("month_start"), F.max("month_start")).first()
    if first is None:
        raise ValueError("no dated transactions")
    return first, last


def month_array(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 month"))


def grid(products: DataFrame, first: datetime.date, last: datetime.date) -> DataFrame:
    """Every product with every month: a row-local explode, no join."""
    months = month_array(F.lit(first), F.lit(last))
    return products.select("*", F.explode(months).alias("month_start"))


def dense_facts(
    f: Facts, first: datetime.date, last: datetime.date
) -> DataFrame:
    """Grid, sales and classes brought together where their products are.

    The three inputs are stacked and folded per (product, month). They are stored in buckets of
    products, so neither the stack nor the fold nor the windows that follow shuffle; inputs that
    are dealt otherwise cross one exchange on the product. A product has at most three rows per
    month, so no product is hot here.
    """
    classes = f.abc.select(
        "product_code",
        jalali.panel_month_of_key(F.col("jalali_month")).alias("month_start"),
        F.col("abc_class"),
    ).where(F.col("month_start").between(F.lit(first), F.lit(last)))
    cells = grid(f.products, first, last)
    sales = f.monthly.drop("jalali_season")
    stacked = cells.unionByName(sales, allowMissingColumns=True).unionByName(
        classes, allowMissingColumns=True
    )
    return (
        stacked.repartition("product_code")
        .groupBy("product_code", "month_start")
        .agg(
            F.max("product_name").alias("product_name"),
            *[F.max(c).alias(c) for c in FACT_COLUMNS],
            F.max("abc_class").alias("abc_class"),
        )
        .na.fill(0, list(FACT_COLUMNS))
        .na.fill("C", ["abc_class"])
    )


def add_calendar(dense: DataFrame) -> DataFrame:
    """Season and month key of the month start. ``jalali_year`` stays the one of the
    month's sales, 0 in a month without any."""
    year_of_sales = dense.withColumnRenamed("jalali_year", "__sales_year")
    return (
        jalali.with_month_features(year_of_sales, "month_start")
        .withColumns(
            {
                "jalali_year": F.col("__sales_year"),
                "abc_encoded": class_code(F.col("abc_class")),
                "g_month": F.month("month_start"),
            }
        )
        .drop("__sales_year", "jalali_month_name")
    )


def by_product() -> Window:
    return Window.partitionBy("product_code").orderBy("month_start")


def add_lags(df: DataFrame, cfg: Config) -> DataFrame:
    w = by_product()
    return df.withColumns(
        {f"lag_{k}": F.coalesce(F.lag("target", k).over(w), F.lit(0.0)) for k in cfg.lags}
    )


def add_rolling(df: DataFrame, cfg: Config) -> DataFrame:
    """Mean and sample deviation of the rows before the current one."""
    w = by_product().rowsBetween(-cfg.rolling, -1)
    return df.withColumns(
        {
            f"rolling_mean_{cfg.rolling}": F.coalesce(F.avg("target").over(w), F.lit(0.0)),
            f"rolling_std_{cfg.rolling}": F.coalesce(
                F.stddev_samp("target").over(w), F.lit(0.0)
            ),
        }
    )


def panel_from_facts(f: Facts, cfg: Config) -> Panel:
    first, last = month_bounds(f.monthly)
    rows = add_rolling(add_lags(add_calendar(dense_facts(f, first, last)), cfg), cfg)
    ordered = rows.select(
        "product_code", "product_name", "month_start", *FACT_COLUMNS, "jalali_season",
        "jalali_month", "abc_class", "abc_encoded", "g_month",
        *[f"lag_{k}" for k in cfg.lags],
        f"rolling_mean_{cfg.rolling}", f"rolling_std_{cfg.rolling}",
    )
    return Panel(ordered, first, last)


def build_panel(prepared: DataFrame, cfg: Config) -> Panel:
    return panel_from_facts(facts(prepared, cfg), cfg)


def total_series(panel: DataFrame) -> DataFrame:
    return panel.groupBy("month_start").agg(F.sum("target").alias("y"))
