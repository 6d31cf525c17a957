"""Winsorising, ABC, panel, split, metrics and forecasts on hand-worked rows."""

from __future__ import annotations

import datetime
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.operators import abc, cleaning, features, forecast, metrics, outliers, panel, split
from anbar.operators.panel import Panel
from anbar.sources.tables import parse_working_days

CFG = Config()
D = datetime.date


def transactions(spark, rows):
    """(jalali date, product, qty) rows, prepared without calendar rows."""
    raw = spark.createDataFrame(
        [(i, d, p, f"name {p}", float(q)) for i, (d, p, q) in enumerate(rows)],
        "seq bigint, jalali_date string, product_code bigint, product_name string, qty double",
    )
    calendar = parse_working_days(
        spark.createDataFrame([("21/03/2024", 1)], "Date string, WorkingDay int")
    )
    return cleaning.prepare(raw, calendar, CFG)[0]


def test_abc_classes(spark):
    rows = [
        ("1403/01", 1, 50), ("1403/01", 2, 30), ("1403/01", 3, 15), ("1403/01", 4, 5),
        ("1403/02", 1, 70), ("1403/02", 2, 20), ("1403/02", 3, 10),
        ("1403/03", 1, 0), ("1403/03", 2, 0),
        ("1403/04", 2, 40), ("1403/04", 1, 40), ("1403/04", 3, 20),
    ]
    df = spark.createDataFrame(rows, "jalali_month string, product_code bigint, qty bigint")
    got = {(r["jalali_month"], r["product_code"]): r for r in abc.monthly_abc(df, CFG).collect()}

    def classes(month, products):
        return "".join(got[month, p]["abc_class"] for p in products)

    assert classes("1403/01", (1, 2, 3, 4)) == "AABC"
    assert classes("1403/02", (1, 2, 3)) == "ABC"
    assert classes("1403/03", (1, 2)) == "CC"
    assert classes("1403/04", (1, 2, 3)) == "AAB"
    assert got["1403/03", 1]["share_pct"] == got["1403/03", 2]["cum_pct"] == 0.0
    assert [got["1403/04", p]["month_rank"] for p in (1, 2, 3)] == [1, 2, 3]
    assert got["1403/01", 2]["cum_pct"] == 80.0


def test_abc_without_dated_rows_is_empty(spark):
    df = spark.createDataFrame([(None, 1, 5)], "jalali_month string, product_code bigint, qty bigint")
    assert abc.monthly_abc(df, CFG).isEmpty()
    joined = abc.add_abc(df, abc.monthly_abc(df, CFG), CFG).collect()
    assert len(joined) == 1 and joined[0]["abc_class"] is None


def pandas_winsor(pdf: pd.DataFrame) -> pd.Series:
    log = np.log1p(pdf["qty"].clip(lower=0))
    low, high = log.quantile(0.25), log.quantile(0.75)
    q = {}
    for code, group in log.groupby(pdf["product_code"]):
        q[code] = (
            (group.quantile(0.25), group.quantile(0.75)) if len(group) >= 10 else (low, high)
        )
    out = []
    for code, qty, value in zip(pdf["product_code"], pdf["qty"], log, strict=True):
        q1, q3 = q[code]
        bound = min(max(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))
        plain = max(qty, 0.0) if bound == value else np.expm1(bound)
        out.append(int(max(np.rint(plain), 0)))
    return pd.Series(out)


def test_winsorise_equals_pandas(spark):
    rng = np.random.default_rng(5)
    sizes = {1: 10, 2: 9, 3: 60, 4: 12, 5: 1}
    rows = [(code, float(q)) for code, n in sizes.items() for q in rng.integers(-3, 40, n)]
    rows += [(3, 5000.0), (3, -7.0), (4, 0.5), (4, 2.5), (4, 4.5)] + [(6, 8.0)] * 11 + [(6, 9.0)]
    pdf = pd.DataFrame(rows, columns=["product_code", "qty"]).reset_index(names="id")
    df = spark.createDataFrame(pdf)
    got = outliers.winsorize(df, CFG).orderBy("id").toPandas()
    assert got["qty"].tolist() == pandas_winsor(pdf).tolist()
    assert got["original_qty"].tolist() == pdf["qty"].tolist()


def test_rows_without_product_survive_winsorising(spark):
    rows = [(1, float(q)) for q in range(1, 13)] + [(None, 3.0), (None, 900.0)]
    df = spark.createDataFrame(rows, "product_code bigint, qty double")
    got = [(r["original_qty"], r["qty"]) for r in outliers.winsorize(df, CFG).collect()
           if r["product_code"] is None]
    log = np.log1p([q for _, q in rows])  # they count in the fences of all rows
    low, high = np.quantile(log, [0.25, 0.75])
    top = int(np.rint(np.expm1(high + 1.5 * (high - low))))
    assert sorted(got) == [(3.0, 3), (900.0, top)]


def test_cells_keep_rows_without_product_for_the_fences(spark):
    rows = [("1403/01/02", 1, 4)] * 3 + [("1403/01/02", None, 1000)]
    f = panel.facts(transactions(spark, rows), CFG)
    fences = {r["product_code"]: r["high"] for r in f.bounds.collect()}
    assert set(fences) == {1, None} and fences[1] == fences[None] > np.log1p(4)
    assert {r["product_code"] for r in f.monthly.collect()} == {1}
    assert [tuple(r) for r in f.months.collect()] == [("1403/01", D(2024, 3, 1), 1)]


@pytest.fixture(scope="module")
def small_panel(spark):
    rows = [("1403/01/02", 1, 3), ("1403/02/15", 1, 5), ("1403/04/15", 1, 7), ("1403/05/15", 1, 9),
            ("1403/01/02", 2, 4), ("1403/02/01", 2, 10), ("1403/05/20", 2, -6)]
    return panel.build_panel(transactions(spark, rows), CFG)


def test_panel_rows(small_panel):
    assert (small_panel.first, small_panel.last, small_panel.months) == (
        D(2024, 3, 1), D(2024, 8, 1), 6,
    )
    rows = small_panel.frame.orderBy("product_code", "month_start").collect()
    assert len(rows) == 12
    one = rows[:6]
    assert [r["target"] for r in one] == [3, 0, 5, 0, 7, 9]
    assert [r["lag_1"] for r in one] == [0, 3, 0, 5, 0, 7]
    empty = one[1]
    assert (empty["jalali_year"], empty["month_rank"], empty["jalali_season"]) == (0, 0, 1)
    assert (empty["jalali_month"], empty["abc_class"], empty["abc_encoded"]) == ("1403/01", "A", 1)
    assert one[0]["working_day"] == 1 and one[2]["working_day"] == 0
    assert one[0]["abc_class"] == "C"  # March 1st lies in 1402/12, which has no sale
    # The return is lifted to the lower fence of all rows: the product has few of its own.
    assert rows[11]["target"] == 1 and rows[11]["original_target"] == -6


def test_rolling_values(spark):
    months = [D(2024, m, 1) for m in range(1, 6)]
    rows = [(1, m, float(t)) for m, t in zip(months, (3, 5, 0, 7, 9), strict=True)]
    df = spark.createDataFrame(rows, "product_code bigint, month_start date, target double")
    out = panel.add_rolling(panel.add_lags(df, CFG), CFG).orderBy("month_start").collect()
    assert [round(r["rolling_mean_3"], 6) for r in out] == [0, 3, 4, 2.666667, 4]
    assert [round(r["rolling_std_3"], 6) for r in out] == [0, 0, 1.414214, 2.516611, 3.605551]
    assert [r["lag_3"] for r in out] == [0, 0, 0, 3, 5]


def test_name_of_a_renamed_product(spark):
    rows = [(1, "old", D(2024, 1, 1)), (1, "new", D(2024, 2, 1)), (1, "newer", D(2024, 2, 1))]
    cells = spark.createDataFrame(rows, "product_code bigint, product_name string, last_day date")
    assert [tuple(r) for r in panel.product_names(cells).collect()] == [(1, "newer")]
    assert [tuple(r) for r in panel.renamed_products(cells).collect()] == [(1, 3)]


@pytest.mark.parametrize(("months", "train"), [(10, 8), (83, 66), (6, 4), (1, 0)])
def test_train_months(months, train):
    assert split.train_months(months, CFG) == train


def test_folds_are_contiguous_and_even(spark):
    rows = [(p, D(2024, m, 1), 1.0) for p in (30, 10, 20, 40) for m in range(1, 6)]
    frame = spark.createDataFrame(rows, "product_code bigint, month_start date, target double")
    p = Panel(frame, D(2024, 1, 1), D(2024, 5, 1))
    products = frame.select("product_code").distinct()
    got = split.add_folds(p, products, CFG).orderBy("product_code", "month_start").collect()
    assert [r["fold"] for r in got] == [0] * 6 + [1] * 5 + [2] * 5
    seven = replace(CFG, train_share=0.4)
    got = split.add_folds(p, products.where("product_code < 40"), seven)
    assert sorted(r["fold"] for r in got.collect()) == [0, 0, 1, 1, 2, 2]


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, p double")
    assert tuple(metrics.evaluate(df, "a", "p").first()) == (1.0, 1.0, 1.0, 75.0)
    assert metrics.model_row(df.where("a > 5"), "a", "p", "m").isEmpty()


def test_feature_candidates_and_scores(small_panel):
    names = features.feature_candidates(small_panel.frame)
    assert sorted(names) == sorted((
        "working_day", "month_txn_count", "share_pct", "cum_pct", "month_rank", "jalali_year",
        "jalali_season", "abc_encoded", "g_month", "lag_1", "lag_2", "lag_3",
        "rolling_mean_3", "rolling_std_3",
    ))
    frame = features.as_features(small_panel.frame, names)
    constant = frame.withColumn("g_month", F.lit(1.0))
    scores = {r[0]: r[1] for r in features.correlations(constant, names).collect()}
    assert scores["g_month"] == 0.0
    assert all(0 <= v <= 1 for v in scores.values())
    mi = {r[0]: r[1] for r in features.mutual_information(constant, names, CFG).collect()}
    assert mi["g_month"] == 0.0 and max(mi.values()) > 0


def test_recursive_forecast(spark):
    months = [D(2024, m, 1) for m in (1, 2, 3)]
    rows = [(1, "a", m, t, 1.0) for m, t in zip(months, (3.0, 6.0, 9.0), strict=True)]
    rows += [(2, "dead", m, 0.0, -1.0) for m in months]
    frame = spark.createDataFrame(
        rows, "product_code bigint, product_name string, month_start date, target double,"
        " original_target double"
    ).withColumn("lag_1", F.lit(0.0))
    p = Panel(frame, months[0], months[-1])
    by_mean = lambda df: df.withColumn("prediction", F.col("rolling_mean_3"))
    got = forecast.recursive_forecast(p, by_mean, "mean", CFG).orderBy("horizon").collect()
    assert [round(r["forecast"], 6) for r in got] == [
        6, 7, 7.333333, 6.777778, 7.037037, 7.049383,
    ]
    assert {r["product_code"] for r in got} == {1}
    assert [r["ds"] for r in got] == [D(2024, m, 1) for m in range(4, 10)]
    # Population deviation of the running targets, and the floor at zero.
    by_std = lambda df: df.withColumn("prediction", -F.col("rolling_std_3"))
    assert {r["forecast"] for r in forecast.recursive_forecast(p, by_std, "s", CFG).collect()} == {0.0}
    spread = lambda df: df.withColumn("prediction", F.col("rolling_std_3"))
    first = forecast.recursive_forecast(p, spread, "s", CFG).where("horizon = 1").first()
    assert first["forecast"] == pytest.approx(np.std([3, 6, 9]))
    # A longer horizon than the lineage cut, and a history shorter than the lags.
    long = forecast.recursive_forecast(p, by_mean, "mean", replace(CFG, horizon=14))
    assert long.count() == 14
    short = Panel(frame.where(F.col("month_start") >= months[1]), months[1], months[-1])
    got = forecast.recursive_forecast(short, by_mean, "mean", CFG).orderBy("horizon").collect()
    assert got[0]["forecast"] == 7.5


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_bin_borders_are_order_statistics(spark, accuracy):
    """Also where the first look at a border is coarse; constants, ties and signs included."""
    rng = np.random.default_rng(4)
    data = {
        "smooth": rng.normal(size=1500),
        "tied": rng.integers(0, 4, 1500).astype(float),
        "mostly": np.where(rng.random(1500) < 0.85, 0.0, rng.random(1500)),
        "constant": np.full(1500, 7.0),
    }
    rows = list(zip(*[v.tolist() for v in data.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))
    for bins in (2, 10):
        found = features.bin_borders(df, list(data), bins, accuracy)
        for c, values in data.items():
            ordered = np.sort(values)
            assert found[c] == sorted({ordered[-(-1500 * i // bins) - 1] for i in range(1, bins)})
    assert features.bin_borders(df.limit(0), list(data), 10) == {c: [] for c in data}
