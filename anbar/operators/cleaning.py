"""Raw stock documents to typed, coded transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anbar.config import (
    LABEL_COLUMNS,
    MISSING_LABEL,
    MISSING_TEXT,
    PERSIAN_TO_CANONICAL,
    Config,
)
from anbar.functions import jalali
from anbar.functions.numbers import is_integral
from anbar.functions.text import number, strip, whole_number
from anbar.operators.joins import Size, fits_broadcast, join_counted
from anbar.operators.prefix import running_totals
from anbar.plans.session import cut_lineage, stored


def rename_columns(df: DataFrame) -> DataFrame:
    """Strip header texts, map Persian headers, insist on a date column."""
    names = [PERSIAN_TO_CANONICAL.get(c.strip(), c.strip()) for c in df.columns]
    if "jalali_date" not in names:
        raise ValueError("no date column")
    return df.toDF(*names)


def present(df: DataFrame, names) -> list[str]:
    """The optional columns that this input has."""
    return [c for c in names if c in df.columns]


def type_values(df: DataFrame) -> DataFrame:
    """Typed product code and quantity, cleaned product name.

    A code that is no whole number becomes null (see ``quarantine``); a bad quantity is 0.
    """
    types = dict(df.dtypes)
    out = df.withColumns(
        {
            "product_code": whole_number(F.col("product_code"), types["product_code"]),
            "qty": F.coalesce(number(F.col("qty"), types["qty"]), F.lit(0.0)),
        }
    )
    if "product_name" in df.columns:
        name = strip(F.coalesce(F.col("product_name").cast("string"), F.lit(MISSING_TEXT)))
        out = out.withColumn("product_name", name)
    return out


def quarantine(typed: DataFrame) -> DataFrame:
    """Rows whose product code is missing or no whole number."""
    return typed.where(F.col("product_code").isNull())


def quantity_summary(typed: DataFrame) -> DataFrame:
    """One row: row count and how many quantities are not whole."""
    return typed.agg(
        F.count("*").alias("rows"),
        F.count(F.when(~is_integral(F.col("qty")), 1)).alias("fractional_rows"),
    )


def clean_labels(df: DataFrame, columns=LABEL_COLUMNS) -> DataFrame:
    return df.withColumns(
        {
            c: strip(F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)))
            for c in present(df, columns)
        }
    )


def label_dictionary(cleaned: DataFrame, columns=LABEL_COLUMNS, seq: str = "seq") -> DataFrame:
    """(label, value, code, n): codes 0, 1, ... by first appearance within each label.

    One pass for all columns: the rows are turned to (label, value) pairs and
    pre-aggregated before the shuffle, so a value owning most rows costs one row per task.
    """
    columns = present(cleaned, columns)
    pairs = cleaned.select(
        F.col(seq).alias("__seq"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in columns])
        ).alias("pair"),
    )
    firsts = pairs.groupBy("pair.label", "pair.value").agg(
        F.min("__seq").alias("first_seen"), F.count("*").alias("n")
    )
    numbered = running_totals(
        stored(firsts), ["label"], [F.col("first_seen"), F.col("value")], {"row": F.lit(1)}
    )
    return numbered.select(
        "label", "value", (F.col("run_row") - 1).cast("int").alias("code"), "n"
    )


def encode_labels(
    cleaned: DataFrame, dictionary: DataFrame, cfg: Config, columns=LABEL_COLUMNS
) -> DataFrame:
    """Replace each label text by its code. One job sizes the dictionaries of all labels.

    Short dictionaries first: rows that cross an exchange for a long one then carry codes in
    place of most texts, and they are stored between two such exchanges, so that only one of
    them is on disk at a time.
    """
    length = F.sum(F.octet_length("value") + 16)
    sizes = dictionary.groupBy("label").agg(
        F.count("*").alias("rows"), F.sum("n").alias("total"), length.alias("bytes")
    )
    size_of = {r["label"]: Size(r["rows"], r["total"], r["bytes"]) for r in sizes.collect()}
    out = cleaned
    nothing, moved = Size(0, 0, 0), False
    for c in sorted(present(cleaned, columns), key=lambda c: size_of.get(c, nothing).rows):
        codes = dictionary.where(F.col("label") == c).select(
            F.col("value").alias(c), F.col("code").alias("__code"), "n"
        )
        size = size_of.get(c, nothing)
        if not fits_broadcast(size, cfg):
            out, moved = stored(out) if moved else out, True
        out = join_counted(out, codes, [c], "n", cfg, size)
        out = out.withColumn(c, F.col("__code")).drop("__code")
    return out


def clean_transactions(raw: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Cleaned transactions with coded labels, and the label dictionary.

    The typed rows are stored: they are read for the dictionary and for the codes.
    """
    typed = clean_labels(type_values(rename_columns(raw)))
    if not present(typed, LABEL_COLUMNS):
        empty = typed.sparkSession.createDataFrame(
            [], "label string, value string, code int, n bigint"
        )
        return typed, empty
    typed = stored(typed)
    dictionary = stored(label_dictionary(typed))
    return encode_labels(typed, dictionary, cfg), dictionary


def add_dates(df: DataFrame, cfg: Config) -> DataFrame:
    """Both calendars' parts from the Jalali date text; bad dates give nulls."""
    j = jalali.JalaliDay(F.col("__jy"), F.col("__jm"), F.col("__jd"))
    date = F.col("gregorian_date")
    return (
        jalali.with_parsed(df, "jalali_date", "__j", cfg.jalali_years)
        .withColumns(
            {
                "jalali_date": F.col("__jtext"),
                "gregorian_date": jalali.to_gregorian(j),
                "jalali_year": j.year,
                "jalali_month": jalali.month_key(j),
                "jalali_month_name": jalali.month_name(j.month),
                "jalali_day": j.day,
                "jalali_season": jalali.season(j.month),
            }
        )
        .drop("__jy", "__jm", "__jd", "__jtext")
        .withColumns(
            {
                "g_year": F.year(date),
                "g_month": F.month(date),
                "g_day": F.day(date),
                "g_weekday": F.weekday(date),
                "month_start": F.trunc(date, "MM"),
            }
        )
    )


def undated(df: DataFrame) -> DataFrame:
    """The rows that ``drop_undated`` leaves out, with the reason."""
    reason = F.when(F.col("jalali_date").isNull(), "no date").otherwise("not a valid date")
    return df.where(F.col("jalali_year").isNull()).withColumn("reason", reason)


def drop_undated(df: DataFrame) -> DataFrame:
    """Keep rows with a valid date. All date columns are null together, so the test on
    the parsed year, which needs no arithmetic, stands for all of them."""
    return df.where(F.col("jalali_year").isNotNull())


def add_working_days(df: DataFrame, calendar: DataFrame, cfg: Config) -> DataFrame:
    """Working-day flag of each date; a date missing from the calendar counts as 0.

    The calendar is reduced to one row per day inside the accepted Jalali years, at most
    366 rows per year, which bounds what is broadcast.
    """
    low, high = cfg.jalali_years
    days = calendar.groupBy("gregorian_date").agg(
        F.max(F.col("working_day").cast("int")).alias("working_day")
    )
    # Written first: the year test would otherwise be repeated on every calendar row.
    days = cut_lineage(days).where(F.year("gregorian_date").between(low + 621, high + 622))
    joined = df.join(F.broadcast(days), "gregorian_date", "left")
    flag = F.coalesce(F.col("working_day"), F.lit(0))
    return joined.select(*df.columns, flag.alias("working_day"))


def input_summary(dated: DataFrame) -> DataFrame:
    """One row about all typed and dated rows: how many, and how many are odd and why."""
    return dated.agg(
        F.count("*").alias("rows"),
        F.count(F.when(~is_integral(F.col("qty")), 1)).alias("fractional_rows"),
        F.count(F.when(F.col("product_code").isNull(), 1)).alias("rows_without_code"),
        F.count(F.when(F.col("jalali_date").isNull(), 1)).alias("rows_without_date"),
        F.count(F.when(F.col("jalali_year").isNull(), 1)).alias("undated_rows"),
    )


def prepare(raw: DataFrame, calendar: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Cleaning, dates and working days in one plan: (dated transactions, dictionary)."""
    cleaned, dictionary = clean_transactions(raw, cfg)
    dated = drop_undated(add_dates(cleaned, cfg))
    return add_working_days(dated, calendar, cfg), dictionary


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
