"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anbar.config import ARABIC_DIGITS, PERSIAN_DIGITS

# Characters that count as white space at either end of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def ascii_digits(c: Column) -> Column:
    """Persian and Arabic-Indic digits become 0-9. A text whose bytes and characters
    are equally many has none of them and is taken as it is."""
    translated = F.translate(c, PERSIAN_DIGITS + ARABIC_DIGITS, "0123456789" * 2)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(translated)


def persian_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", PERSIAN_DIGITS)


def number_from_text(c: Column) -> Column:
    """DOUBLE of a number text; null when it is not a plain number.

    The pattern is needed because a cast alone also takes '1d', '0x1p3' and 'NaN'.
    """
    text = strip(F.replace(ascii_digits(c), F.lit(","), F.lit("")))
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def whole_number(c: Column, dtype: str) -> Column:
    """BIGINT of a text or numeric column, exact for every BIGINT; null when not whole."""
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        return c.cast("bigint")
    if dtype.startswith("decimal"):
        return F.when(c % F.lit(1) == F.lit(0), c.try_cast("bigint"))
    value = number(c, dtype)
    rounded = F.when(value % F.lit(1) == F.lit(0), value.try_cast("bigint"))
    if dtype != "string":
        return rounded
    text = strip(F.replace(ascii_digits(c), F.lit(","), F.lit("")))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).otherwise(rounded)


def number(c: Column, dtype: str) -> Column:
    """DOUBLE of a text or numeric column; NaN counts as missing."""
    if dtype == "string":
        return number_from_text(c)
    value = c.cast("double")
    return F.when(~F.isnan(value), value)
