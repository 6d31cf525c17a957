"""Jalali (solar Hijri) calendar as integer column arithmetic.

The 33-year arithmetic cycle: eight leap years per cycle. Every function takes and
returns columns, so dates never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anbar.config import ARABIC_DIGITS, JALALI_MONTH_NAMES, PERSIAN_DIGITS
from anbar.functions.numbers import int_div
from anbar.functions.text import ascii_digits, strip

# 1403/1/1 is 2024-03-20; its day number; leap remainders of year % 33.
ANCHOR_DATE = "2024-03-20"
ANCHOR_DAY = 1094998
LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)
CYCLE_DAYS = 12053
FOUR_YEAR_DAYS = 1461
YEAR_SHIFT = 1595


@dataclass(frozen=True)
class JalaliDay:
    year: Column
    month: Column
    day: Column


def day_number(j: JalaliDay) -> Column:
    y = j.year + F.lit(YEAR_SHIFT)
    before_month = F.when(j.month < 7, (j.month - 1) * 31).otherwise((j.month - 7) * 30 + 186)
    leap_days = int_div(y, 33) * 8 + int_div(y % 33 + 3, 4)
    return y * 365 + leap_days + j.day + before_month


def is_valid(j: JalaliDay, years: tuple[int, int]) -> Column:
    leap = (j.year % 33).isin(*LEAP_REMAINDERS)
    month_days = (
        F.when(j.month <= 6, 31).when(j.month <= 11, 30).when(leap, 30).otherwise(29)
    )
    fits = j.month.between(1, 12) & (j.day >= 1) & (j.day <= month_days)
    return F.coalesce(j.year.between(*years) & fits, F.lit(False))


def to_gregorian(j: JalaliDay) -> Column:
    shift = (day_number(j) - F.lit(ANCHOR_DAY)).cast("int")
    return F.date_add(F.to_date(F.lit(ANCHOR_DATE)), shift)


def with_jalali(df: DataFrame, date: str, prefix: str) -> DataFrame:
    """Add ``<prefix>y``, ``<prefix>m``, ``<prefix>d``: the Jalali day of a date column.

    Built in steps: a column used several times by the next step stays a column of its
    own in the plan, so the generated code does not grow with every use.
    """
    since, cycle, four, rest, leap = (f"__{prefix}{n}" for n in "abcde")
    days = F.datediff(F.col(date), F.to_date(F.lit(ANCHOR_DATE))) + F.lit(ANCHOR_DAY - 1)
    after = F.col(four) - 1
    stepped = (
        df.withColumn(since, days)
        .withColumn(cycle, F.col(since) % CYCLE_DAYS)
        .withColumn(four, F.col(cycle) % FOUR_YEAR_DAYS)
        .withColumn(leap, F.col(four) > 365)
        .withColumn(rest, F.when(F.col(leap), after % 365).otherwise(F.col(four)))
    )
    years = (
        int_div(F.col(since), CYCLE_DAYS) * 33
        + int_div(F.col(cycle), FOUR_YEAR_DAYS) * 4
        + F.when(F.col(leap), int_div(after, 365)).otherwise(F.lit(0))
        - YEAR_SHIFT
    )
    r = F.col(rest)
    month = F.when(r < 186, int_div(r, 31) + 1).otherwise(int_div(r - 186, 30) + 7)
    day = F.when(r < 186, r % 31 + 1).otherwise((r - 186) % 30 + 1)
    return stepped.withColumns(
        {
            f"{prefix}y": years.cast("int"),
            f"{prefix}m": month.cast("int"),
            f"{prefix}d": day.cast("int"),
        }
    ).drop(since, cycle, four, rest, leap)


# The usual form, ten characters with any digit set.
ANY_DIGIT = f"[0-9{PERSIAN_DIGITS}{ARABIC_DIGITS}]"
FIXED_TEXT = rf"^{ANY_DIGIT}{{4}}([/.-]){ANY_DIGIT}{{2}}\1{ANY_DIGIT}{{2}}$"
# Three whole numbers, twice the same separator, then nothing or a space and anything.
DATE_TEXT = r"(?s)^[\t-\r]*\+?\d+[\t-\r]*([/.-])[\t-\r]*\+?\d+[\t-\r]*\1[\t-\r]*\+?\d+(\s.*)?$"


def with_parsed(df: DataFrame, text: str, prefix: str, years: tuple[int, int]) -> DataFrame:
    """Add ``<prefix>y/m/d`` from a date text, null unless it is a valid day, and
    ``<prefix>text``, the trimmed text with plain digits.

    Read is the text up to the first space, digits of any set, parts separated by ``/``,
    ``-`` or ``.``. Ten-character texts, nearly all in practice, are cut by position; the
    others are trimmed and split. The result is bound by a one-row generator: a later
    "is not null" filter would otherwise be pushed below and parse every text again.
    """
    source, fixed, clean, sep, ok = (
        f"__{prefix}{n}" for n in ("source", "fixed", "text", "sep", "ok")
    )
    raw = [f"__{prefix}{n}" for n in "ymd"]
    t, is_fixed = F.col(clean), F.col(fixed)
    kind = F.when(F.contains(t, F.lit("/")), "/").when(F.contains(t, F.lit("-")), "-")
    head = F.substring_index(t, " ", 1)
    spans = ((1, 4), (6, 2), (9, 2))
    pieces = [
        F.when(is_fixed, F.substring(t, *span)).when(
            F.col(sep).isNotNull(), F.split_part(head, F.col(sep), F.lit(i))
        )
        for i, span in enumerate(spans, start=1)
    ]
    staged = (
        df.withColumn(source, F.col(text).cast("string"))
        .withColumn(fixed, F.col(source).rlike(FIXED_TEXT))
        .withColumn(source, F.when(is_fixed, F.col(source)).otherwise(strip(F.col(source))))
        .withColumn(clean, ascii_digits(F.col(source)))
        .withColumn(sep, F.when(~is_fixed & t.rlike(DATE_TEXT), kind.otherwise(".")))
        .withColumns({c: piece.try_cast("int") for c, piece in zip(raw, pieces, strict=True)})
        .withColumn(ok, is_valid(JalaliDay(*[F.col(c) for c in raw]), years))
    )
    checked = [
        F.when(F.col(ok), F.col(c)).alias(f"{prefix}{n}")
        for n, c in zip("ymd", raw, strict=True)
    ]
    bound = F.inline(F.array(F.struct(*checked, t.alias(f"{prefix}text"))))
    return staged.select(*df.columns, bound)


def month_key(j: JalaliDay) -> Column:
    """Sortable ``YYYY/MM``; years have four digits."""
    digits = (j.year * 100 + j.month).cast("string")
    return F.concat(F.substring(digits, 1, 4), F.lit("/"), F.substring(digits, 5, 2))


def day_key(j: JalaliDay) -> Column:
    """``YYYY/MM/DD``."""
    digits = (j.year * 10000 + j.month * 100 + j.day).cast("string")
    parts = [F.substring(digits, *span) for span in ((1, 4), (5, 2), (7, 2))]
    return F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"), parts[2])


def month_name(month: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in JALALI_MONTH_NAMES]), month - 1)


def season(month: Column) -> Column:
    return (int_div(month - 1, 3) + 1).cast("int")


def year_of_key(key: Column) -> Column:
    return F.substring_index(key, "/", 1).cast("int")


def month_of_key(key: Column) -> Column:
    return F.substring_index(key, "/", -1).cast("int")


def key_order(key: Column) -> list[Column]:
    """Numeric sort columns of a ``Y/M`` label; an empty label sorts first."""
    return [
        F.coalesce(F.substring_index(key, "/", 1).try_cast("int"), F.lit(0)),
        F.coalesce(F.substring_index(key, "/", -1).try_cast("int"), F.lit(0)),
    ]


def panel_month_of_key(key: Column) -> Column:
    """The Gregorian month start that lies inside a Jalali month.

    A Jalali month starts between day 19 and 23 and lasts 29 to 31 days, so exactly one
    first-of-month falls into it.
    """
    first = to_gregorian(JalaliDay(year_of_key(key), month_of_key(key), F.lit(1)))
    return F.add_months(F.trunc(first, "MM"), 1)


def with_month_features(df: DataFrame, date: str) -> DataFrame:
    """Add Jalali month key, name, season and year of a date column."""
    j = JalaliDay(F.col("__py"), F.col("__pm"), F.col("__pd"))
    return (
        with_jalali(df, date, "__p")
        .withColumns(
            {
                "jalali_month": month_key(j),
                "jalali_month_name": month_name(j.month),
                "jalali_season": season(j.month),
                "jalali_year": j.year,
            }
        )
        .drop("__py", "__pm", "__pd")
    )


def future_months(last: Column, horizon: int) -> Column:
    """Array of the next ``horizon`` month starts."""
    return F.sequence(
        F.add_months(last, 1), F.add_months(last, horizon), F.expr("interval 1 month")
    )
