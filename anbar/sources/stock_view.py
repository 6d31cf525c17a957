"""Stock transactions derived from order-line tables (lineitem, orders, part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.config import ARABIC_DIGITS
from anbar.functions import jalali
from anbar.functions.text import persian_digits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(
    spark: SparkSession, sf_dir: str, variant: str = "plain", labels: bool = False
) -> DataFrame:
    """Raw document lines: Jalali date text, quantity, product, optional label columns.

    ``orders`` is joined only when the label columns are asked for. Variants: ``small`` makes
    many products with few rows, one per part and supplier; ``returns`` turns some
    quantities negative.
    """
    lines = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity")
    if variant == "returns":
        returned = (F.col("l_partkey") % 50 == 0) | (
            (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
        )
        qty = F.when(returned, -qty).otherwise(qty)

    code = F.col("l_partkey")
    if variant == "small":
        code = code * 1_000_000 + F.col("l_suppkey")

    parts = table(spark, sf_dir, "part")
    part_columns = [F.col("p_name").alias("product_name")]
    joined = lines.withColumn("day", F.to_date("l_shipdate"))
    if labels:
        # Before the parts: a part's texts are wider than what an order adds to the lines.
        orders = table(spark, sf_dir, "orders")
        joined = joined.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        part_columns += [
            F.col("l_returnflag").alias("doc_type"),
            F.col("l_linestatus").alias("status"),
            F.col("p_type").alias("product_nature"),
            F.col("p_brand").alias("unit"),
            F.col("l_suppkey").cast("string").alias("warehouse"),
            F.col("o_custkey").cast("string").alias("counterparty"),
            F.col("o_orderpriority").alias("consumption_location"),
        ]
    joined = joined.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    # The date texts are made after the joins, so that they do not travel.
    joined = jalali.with_jalali(joined, "day", "j")
    j = jalali.JalaliDay(F.col("jy"), F.col("jm"), F.col("jd"))
    joined = joined.withColumn("text", jalali.day_key(j))
    text = F.when(F.col("l_linenumber") % 2 == 0, persian_digits(F.col("text"))).otherwise(
        F.col("text")
    )
    columns = [
        F.struct("day", "l_orderkey", "l_linenumber").alias("seq"),
        text.alias("jalali_date"),
        qty.alias("qty"),
        code.alias("product_code"),
    ]
    return joined.select(*columns, *part_columns)


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as text under Persian headers, with the faults that real documents have.

    What is done to a line follows from its order key and line number. Dates: the three
    separators, Persian and Arabic digits, times, years about 1100 and 1620, days that do not
    exist, no date. Codes: 19 digits, signs and commas, decimals, texts, none. Quantities:
    thousands separators, exponents, fractions, texts, none.
    """
    lines = table(spark, sf_dir, "lineitem")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    day = F.to_date("l_shipdate")
    day = F.when(order % 13 == 5, F.add_months(day, -12 * 275)).when(
        order % 13 == 6, F.add_months(day, 12 * 245)
    ).otherwise(day)
    lines = jalali.with_jalali(lines.withColumn("day", day), "day", "j")
    parts = [F.col(c).cast("string") for c in ("jy", "jm", "jd")]
    wide = [F.lpad(p, n, "0") for p, n in zip(parts, (4, 2, 2), strict=True)]
    date = (
        F.when(order % 17 == 1, F.concat(parts[0], F.lit("/13/01")))
        .when(order % 17 == 2, F.lit("تاریخ"))
        .when(order % 17 == 3, F.lit(None))
        .when(order % 17 == 4, F.concat(F.lit(" "), F.concat_ws("/", *wide), F.lit(" 10:20 ")))
        .when(order % 17 == 5, F.concat_ws("-", *parts))
        .when(order % 17 == 6, F.concat_ws(".", *wide))
        .when(order % 17 == 7, F.concat(parts[0], F.lit("/07/31")))
        .otherwise(F.concat_ws("/", *wide))
    )
    arabic = F.translate(date, "0123456789", ARABIC_DIGITS)
    date = F.when(line % 3 == 1, persian_digits(date)).when(line % 3 == 2, arabic).otherwise(date)
    part = F.col("l_partkey").cast("string")
    code = (
        F.when(order % 19 == 1, F.concat(F.lit("9007199254"), F.lpad(part, 9, "0")))
        .when(order % 19 == 2, F.lit("x"))
        .when(order % 19 == 3, F.lit(None))
        .when(order % 19 == 4, F.concat(part, F.lit(".5")))
        .when(order % 19 == 5, F.concat(part, F.lit(".0")))
        .when(order % 19 == 6, F.concat(F.lit("+"), persian_digits(part)))
        .when(order % 19 == 7, F.concat(part, F.lit(",000")))
        .otherwise(part)
    )
    whole = F.col("l_quantity").cast("int").cast("string")
    qty = (
        F.when(order % 23 == 1, F.concat(F.lit("1,0"), F.lpad(whole, 2, "0")))
        .when(order % 23 == 2, F.lit("abc"))
        .when(order % 23 == 3, F.lit(None))
        .when(order % 23 == 4, F.concat(whole, F.lit(".5")))
        .when(order % 23 == 5, F.concat(whole, F.lit("e1")))
        .when(order % 23 == 6, F.concat(F.lit("-"), persian_digits(whole)))
        .when(order % 23 == 7, F.concat(whole, F.lit("d")))
        .otherwise(whole)
    )
    return lines.select(
        F.struct("l_orderkey", line).alias("seq"),
        date.alias(" تاریخ "), code.alias("کد کالا"), qty.alias("مقدار (اصلی)"),
        F.when(order % 29 != 1, F.concat(F.lit("  "), part, F.lit(" "))).alias("نام کالا"),
    )


def working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar text rows: Fridays are off; days numbered 15 are left out."""
    date = F.to_date("l_shipdate")
    days = table(spark, sf_dir, "lineitem").select(date.alias("d")).distinct()
    return days.where(F.day("d") != 15).select(
        F.date_format("d", "dd/MM/yyyy").alias("Date"),
        F.when(F.weekday("d") == 4, 0).otherwise(1).alias("WorkingDay"),
    )
