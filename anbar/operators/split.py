"""Time split and cross-validation folds."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.operators.panel import Panel
from anbar.operators.prefix import dense_positions


def month_index(month_start: Column, first: datetime.date) -> Column:
    """0 for the first month of the grid; the grid has no gaps."""
    return (F.year(month_start) - first.year) * 12 + F.month(month_start) - first.month


def train_months(months: int, cfg: Config) -> int:
    return math.floor(months * cfg.train_share)


def split_panel(panel: Panel, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Train rows (the first months) and test rows: a row-local predicate."""
    index = month_index(F.col("month_start"), panel.first)
    border = train_months(panel.months, cfg)
    return panel.frame.where(index < border), panel.frame.where(index >= border)


def mark_split(panel: Panel, cfg: Config) -> DataFrame:
    index = month_index(F.col("month_start"), panel.first)
    is_train = index < train_months(panel.months, cfg)
    return panel.frame.withColumn("split", F.when(is_train, "train").otherwise("test"))


def add_folds(panel: Panel, products: DataFrame, cfg: Config) -> DataFrame:
    """Train rows with ``fold``: contiguous in (product, month) order, sizes as even as
    possible, the first ones longer.

    The position of a row is product number x train months + month number, so only the
    products are numbered; the panel itself is not sorted.
    """
    train, _ = split_panel(panel, cfg)
    numbered = dense_positions(products.select("product_code"), [F.col("product_code")], "__p")
    size = train_months(panel.months, cfg)
    rows = numbered.count() * size
    short, longer = divmod(rows, cfg.folds)
    position = F.col("__p") * size + month_index(F.col("month_start"), panel.first)
    head = longer * (short + 1)
    fold = F.when(position < head, F.floor(position / (short + 1))).otherwise(
        longer + F.floor((position - head) / max(short, 1))
    )
    # Each product appears at most once per month on the left: no hot key.
    return (
        train.join(numbered, "product_code")
        .withColumn("fold", fold.cast("int"))
        .drop("__p")
    )
