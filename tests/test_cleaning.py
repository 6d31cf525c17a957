"""Hand-worked rows for dates, numbers, texts, labels and the calendar."""

from __future__ import annotations

import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.functions import jalali
from anbar.operators import cleaning, outliers
from anbar.sources.tables import (
    parse_working_days,
    read_transactions,
    read_working_days,
    text_columns,
)

CFG = Config()
D = datetime.date

# (date text, Gregorian date, quantity text, quantity, product text, product code)
EDGE_ROWS = [
    ("۱۴۰۳/۰۱/۰۱", D(2024, 3, 20), "۱,۲۳۴", 1234.0, "101", 101),
    ("1403-12-30", D(2025, 3, 20), "-5", -5.0, "101", 101),
    ("1402.12.29", D(2024, 3, 19), "2.5", 2.5, "102", 102),
    ("1402/12/30", None, "abc", 0.0, "102", 102),
    ("1403/7/31 10:20", None, "", 0.0, "103", 103),
    ("1403/7/30 10:20", D(2024, 10, 21), "+7", 7.0, "103", 103),
    (" ٠١/٠٢/١٤٠٣ ", None, "7", 7.0, "103", 103),
    ("1403/01", None, "8", 8.0, "104", 104),
    (None, None, None, 0.0, None, None),
    ("1403/13/01", None, "1d", 0.0, "105", 105),
    ("1403/06/31 ", D(2024, 9, 21), "1e3", 1000.0, "x", None),
    ("1402/5-3", None, "3.5", 3.5, "106", 106),
    ("1402/5/3.5", None, "0x1p3", 0.0, "106.5", None),
    ("1402/5/3/1", None, " 1,000 ", 1000.0, "۱۰۷", 107),
    ("99/01/01", None, "NaN", 0.0, "106", 106),
    ("1403/0/5", None, "inf", 0.0, "106", 106),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, r[0], r[2], r[4]) for i, r in enumerate(EDGE_ROWS)]
    return spark.createDataFrame(rows, "seq bigint, `تاریخ ` string, `مقدار (اصلی)` string, `کد کالا` string")


def test_edge_dates_and_numbers(raw):
    typed = cleaning.type_values(cleaning.rename_columns(raw))
    got = {r["seq"]: r for r in cleaning.add_dates(typed, CFG).collect()}
    for i, (_, date, _, qty, _, code) in enumerate(EDGE_ROWS):
        assert (got[i]["gregorian_date"], got[i]["qty"], got[i]["product_code"]) == (
            date, qty, code,
        ), EDGE_ROWS[i]
        assert (got[i]["jalali_month"] is None) == (date is None)
    first = got[0]
    assert first["jalali_date"] == "1403/01/01"
    assert (first["g_weekday"], first["jalali_season"], first["jalali_month"]) == (2, 1, "1403/01")
    assert first["month_start"] == D(2024, 3, 1)


def test_undated_and_quarantined_rows(raw):
    typed = cleaning.type_values(cleaning.rename_columns(raw))
    assert {r["seq"] for r in cleaning.quarantine(typed).collect()} == {8, 10, 12}
    kept = cleaning.drop_undated(cleaning.add_dates(typed, CFG))
    assert {r["seq"] for r in kept.collect()} == {
        i for i, r in enumerate(EDGE_ROWS) if r[1] is not None
    }
    summary = cleaning.quantity_summary(typed).first()
    assert (summary["rows"], summary["fractional_rows"]) == (len(EDGE_ROWS), 2)


def test_parse_is_not_repeated_by_the_filter(raw):
    typed = cleaning.type_values(cleaning.rename_columns(raw))
    plan = cleaning.drop_undated(cleaning.add_dates(typed, CFG))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("RLIKE (?s)") <= 1


def test_missing_date_column(spark):
    with pytest.raises(ValueError):
        cleaning.rename_columns(spark.createDataFrame([(1,)], "qty int"))


def test_label_codes_follow_first_appearance(spark):
    rows = [(0, "b", "n"), (1, None, None), (2, " b ", " x "), (3, "a", "n")]
    raw = spark.createDataFrame(rows, "seq bigint, doc_type string, product_name string")
    raw = raw.selectExpr("*", "'1403/01/01' jalali_date", "1.0D qty", "1L product_code")
    cleaned, dictionary = cleaning.clean_transactions(raw, CFG)
    got = {r["seq"]: r for r in cleaned.collect()}
    assert [got[i]["doc_type"] for i in range(4)] == [0, 1, 0, 2]
    assert [got[i]["product_name"] for i in range(4)] == ["n", "نامشخص", "x", "n"]
    assert {(r["value"], r["code"], r["n"]) for r in dictionary.collect()} == {
        ("b", 0, 2), ("Unknown", 1, 1), ("a", 2, 1),
    }


def test_years_of_the_timestamp_range_are_kept(spark):
    texts = ["1150/01/01", "1610/01/01", "1056/01/01", "1641/01/01", "1055/12/29", "1642/01/01"]
    raw = spark.createDataFrame([(t,) for t in texts], "jalali_date string")
    got = {r["jalali_date"]: r["gregorian_date"] for r in cleaning.add_dates(raw, CFG).collect()}
    assert got["1150/01/01"] == D(1771, 3, 21) and got["1610/01/01"] == D(2231, 3, 21)
    assert [got[t] is None for t in texts] == [False] * 4 + [True] * 2


def test_long_product_codes_are_exact(spark):
    texts = ["9007199254740993", "9007199254740992", "1234567890123456789", "-9223372036854775808",
             "9223372036854775808", "+7", "7.0", "7.5", "1e3", "۱,۰۰۰"]
    raw = spark.createDataFrame([(t, "1", "1403/01/01") for t in texts], "product_code string, qty string, jalali_date string")
    got = [r["product_code"] for r in cleaning.type_values(raw).collect()]
    assert got == [9007199254740993, 9007199254740992, 1234567890123456789, -2**63, None, 7, 7, None, 1000, 1000]
    decimal = raw.limit(3).withColumn("product_code", F.col("product_code").cast("decimal(20,1)"))
    assert [r["product_code"] for r in cleaning.type_values(decimal).collect()] == got[:3]


def test_dropped_rows_are_told(raw):
    dated = cleaning.add_dates(cleaning.type_values(cleaning.rename_columns(raw)), CFG)
    reasons = {r["seq"]: r["reason"] for r in cleaning.undated(dated).collect()}
    assert set(reasons) == {i for i, r in enumerate(EDGE_ROWS) if r[1] is None}
    assert {i for i, r in reasons.items() if r == "no date"} == {8}
    summary = cleaning.input_summary(dated).first().asDict()
    assert summary == {"rows": 16, "fractional_rows": 2, "rows_without_code": 3,
                       "rows_without_date": 1, "undated_rows": len(reasons)}


@settings(max_examples=200, deadline=None)
@given(st.integers(1056, 1640), st.integers(1, 12), st.integers(1, 31))
def test_jalali_days_follow_the_calendar(year, month, day):
    """A day exists unless it is beyond its month; 12/30 only in leap years of 33."""
    leap = year % 33 in (1, 5, 9, 13, 17, 22, 26, 30)
    exists = day <= 30 + (month <= 6) - (month == 12 and not leap)
    DAYS.setdefault((year, month, day), exists)


DAYS: dict[tuple[int, int, int], bool] = {}


def test_generated_days_are_valid_or_null(spark):
    test_jalali_days_follow_the_calendar()
    rows = [(f"{y}/{m}/{d}", ok) for (y, m, d), ok in DAYS.items()]
    df = cleaning.add_dates(spark.createDataFrame(rows, "jalali_date string, ok boolean"), CFG)
    assert df.where("(gregorian_date is not null) <> ok").isEmpty()
    back = jalali.with_jalali(df.where("ok"), "gregorian_date", "b")
    assert back.where("by <> jalali_year or bd <> jalali_day").isEmpty()


def test_numeric_input_columns_pass(spark):
    raw = spark.createDataFrame(
        [(1.0, float("nan")), (2.5, 3.0), (None, None)], "product_code double, qty double"
    ).withColumn("jalali_date", F.lit("1403/01/01"))
    rows = cleaning.type_values(raw).collect()
    assert [(r["product_code"], r["qty"]) for r in rows] == [(1, 0.0), (None, 3.0), (None, 0.0)]


def test_calendar_round_trip(spark):
    days = spark.sql(
        "SELECT explode(sequence(date'1900-01-01', date'2100-12-31', interval 1 day)) d"
    )
    j = jalali.JalaliDay(F.col("jy"), F.col("jm"), F.col("jd"))
    checked = jalali.with_jalali(days, "d", "j").withColumns(
        {"back": jalali.to_gregorian(j), "ok": jalali.is_valid(j, (1200, 1600))}
    )
    assert checked.where("back <> d OR NOT ok").isEmpty()
    anchors = {"2025-03-21": (1404, 1, 1), "2021-03-20": (1399, 12, 30), "1979-02-11": (1357, 11, 22)}
    for day, parts in anchors.items():
        row = checked.where(F.col("d") == day).first()
        assert (row["jy"], row["jm"], row["jd"]) == parts


def test_each_jalali_month_holds_one_month_start(spark):
    months = spark.sql(
        "SELECT explode(sequence(date'1850-01-01', date'2200-12-01', interval 1 month)) m"
    )
    keyed = jalali.with_month_features(months, "m")
    back = keyed.withColumn("back", jalali.panel_month_of_key(F.col("jalali_month")))
    assert back.where("back <> m").isEmpty()
    assert keyed.select("jalali_month").distinct().count() == keyed.count()


def test_label_order_is_numeric(spark):
    df = spark.createDataFrame([("1380/10",), ("1380/9",), ("",), ("999/12",)], "k string")
    rows = df.orderBy(*jalali.key_order(F.col("k"))).collect()
    assert [r["k"] for r in rows] == ["", "999/12", "1380/9", "1380/10"]


def test_working_days(spark, tmp_path):
    path = tmp_path / "days.csv"
    path.write_text("Date,WorkingDay\n20/03/2024,1\n5/4/2024,1\n20/03/2024,0\n")
    calendar = read_working_days(spark, str(path))
    dates = spark.sql(
        "SELECT explode(array(date'2024-03-20', date'2024-04-05', date'2024-04-06'))"
        " gregorian_date"
    )
    got = cleaning.add_working_days(dates, calendar, CFG).collect()
    assert {(r["gregorian_date"].day, r["working_day"]) for r in got} == {(20, 1), (5, 1), (6, 0)}
    assert len(got) == 3
    bad = spark.createDataFrame([("2024-03-20", 1)], "Date string, WorkingDay int")
    with pytest.raises(Exception, match="date|parse|DATE"):
        parse_working_days(bad).collect()


def test_read_transactions_formats(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text(" تاریخ ,کد کالا,مقدار (اصلی)\n1403/01/02,7,5\n1403/01/03,8,6\n")
    df = read_transactions(spark, str(path), "csv")
    assert df.columns == ["تاریخ", "کد کالا", "مقدار (اصلی)", "seq"]
    typed = cleaning.type_values(cleaning.rename_columns(df)).orderBy("seq").collect()
    assert [(r["product_code"], r["qty"]) for r in typed] == [(7, 5.0), (8, 6.0)]
    for fmt in ("json", "orc", "parquet"):
        out = str(tmp_path / fmt)
        df.drop("seq").write.format(fmt).save(out)
        schema = text_columns(df.columns[:3]) if fmt == "json" else None
        assert set(read_transactions(spark, out, fmt, schema).columns) == set(df.columns)
    with pytest.raises(ValueError, match="schema"):
        read_transactions(spark, str(tmp_path / "json"), "json")


def test_fence_at_a_half(spark):
    """Quartiles 11 and 47 put the lower fence at 0.5 up to the last bit: half to even is 0."""
    quantities = [0.0, 11.0, 11.0, 11.0, 11.0, 20.0, 47.0, 47.0, 47.0, 47.0, 500.0]
    rows = spark.createDataFrame([(1, q) for q in quantities], "product_code long, qty double")
    bounds = outliers.quantity_bounds(rows, Config()).first()
    assert abs(bounds["low"] - math.log(1.5)) < 1e-12 and abs(bounds["high"] - math.log(384)) < 1e-12
    found = sorted((r.original_qty, r.qty) for r in outliers.winsorize(rows, Config()).collect())
    assert found[0] == (0.0, 0) and found[-1] == (500.0, 383) and found[1] == (11.0, 11)
