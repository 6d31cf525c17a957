"""Series fits, sequence windows and the whole run."""

from __future__ import annotations

import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from anbar.__main__ import arguments, main
from anbar.config import Config, model_codes
from anbar.models import sequence, series, tree
from anbar.operators.abc import abc_export
from anbar.operators.panel import Panel
from anbar.plans import run as whole
from anbar.plans.run import run
from anbar.plans.stages import Stages, fingerprint
from anbar.sources import stock_view
from anbar.sources.sinks import persian_headers
from anbar.sources.tables import parse_working_days
from catalog import spark_queries

CFG = Config()
# Smaller grids than the shipped ones.
SMALL = replace(
    CFG,
    rf_trees=20, rf_depths=(3, 5), rf_leaf_rows=(1,),
    gbt_rounds=(10,), gbt_depths=(3, 5), gbt_rates=(0.1,), gbt_leaf_rows=(1,),
    importance_trees=20, importance_tree_depth=5,
    importance_rounds=10, importance_round_depth=4,
    seq_candidates=((5, 3, 0.1), (10, 3, 0.1)),
    max_bins=32, report_from_year=1379,
)
SF = "/root/testdata/sf0.001"


def months(n: int) -> list[datetime.date]:
    return [datetime.date(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]


def seasonal(n: int) -> np.ndarray:
    t = np.arange(n, dtype=float)
    return 1000 + 5 * t + 200 * np.sin(2 * np.pi * t / 12)


def noisy() -> np.ndarray:
    return seasonal(72) + np.random.default_rng(0).normal(0, 5, 72)


def panel_of(spark, series_by_product: dict[int, np.ndarray]) -> Panel:
    n = len(next(iter(series_by_product.values())))
    rows = [
        (p, f"n{p}", m, float(v), float(v), float(m.month))
        for p, values in series_by_product.items()
        for m, v in zip(months(n), values, strict=True)
    ]
    frame = spark.createDataFrame(
        rows,
        "product_code bigint, product_name string, month_start date, target double,"
        " original_target double, g_month double",
    )
    return Panel(frame, months(n)[0], months(n)[-1])


@pytest.mark.parametrize("prior", series.TREND_PRIORS)
def test_trend_recovers_trend_and_season(prior):
    ahead = series.fit_trend(noisy(), 12, prior, "additive")
    assert np.abs(ahead - seasonal(84)[72:]).mean() < 10


def test_every_sarima_candidate_can_be_fitted():
    for order in series.ARIMA_ORDERS:
        for seasonal_order in series.SEASONAL_ORDERS:
            ahead = series.fit_sarima(noisy(), 12, order, seasonal_order)
            assert len(ahead) == 12 and np.isfinite(ahead).all()
    best = series.fit_sarima(noisy(), 12, (0, 1, 1), (0, 1, 1))
    assert np.abs(best - seasonal(84)[72:]).mean() < 40


def test_short_series_is_an_error():
    with pytest.raises(ValueError, match="short"):
        series.fit_sarima(np.arange(6.0), 2, (1, 1, 1), (0, 0, 0))


@pytest.mark.parametrize("code", ["trend", "sarima"])
def test_series_forecast_by_product(spark, code):
    flat = np.full(72, 40.0)
    p = panel_of(spark, {1: noisy(), 2: flat + np.arange(72) % 2})
    result = series.forecast_series(p, code, "m", CFG, ["product_code"])
    rows = result.forecasts.orderBy("product_code", "ds").collect()
    assert [(r["product_code"], r["ds"]) for r in rows] == [
        (k, datetime.date(2021, m, 1)) for k in (1, 2) for m in range(1, 7)
    ]
    one = np.array([r["forecast"] for r in rows[:6]])
    assert np.abs(one - seasonal(78)[72:]).mean() < 60
    assert result.test.count() == 2 * 15
    assert {r["failed"] for r in result.failures.collect()} == {0}


def test_series_that_doubles_keeps_its_forecast(spark):
    doubling = 2.0 ** np.arange(72)
    p = panel_of(spark, {1: doubling, 2: noisy()})
    result = series.forecast_series(p, "sarima", "m", CFG, ["product_code"])
    rows = result.forecasts.orderBy("product_code", "ds").collect()
    assert [r["product_code"] for r in rows] == [1] * 6 + [2] * 6
    assert np.allclose([r["forecast"] for r in rows[:6]], 2.0 ** np.arange(72, 78), rtol=1e-3)
    assert result.skipped.isEmpty()


def test_failed_refits_fall_back_and_are_told(spark, monkeypatch):
    def fit(y, steps, candidate):
        rank, refit = candidate["rank"], steps > 2
        if y[0] > 500 or (refit and rank < 2):
            raise ValueError("no")
        return np.full(steps, float(rank))

    monkeypatch.setitem(series.FITTERS, "sarima", (series.sarima_candidates, fit))
    p = panel_of(spark, {1: np.zeros(20) + 0.5, 2: np.full(20, 900.0)})
    result = series.forecast_series(p, "sarima", "m", CFG, ["product_code"])
    assert {(r["product_code"], r["forecast"]) for r in result.forecasts.collect()} == {(1, 2.0)}
    assert [(r["product_code"], r["reason"][:12]) for r in result.skipped.collect()] == [(2, "no candidate")]


def test_series_needs_six_train_months(spark):
    p = panel_of(spark, {1: np.arange(7.0)})
    assert series.forecast_series(p, "trend", "m", CFG) is None


def test_sequences_stay_inside_their_split(spark):
    p = panel_of(spark, {1: np.arange(25.0)})
    scaled = sequence.scaled_panel(p, ["target", "g_month"], CFG)
    rows = sequence.sequences(scaled, ["target"], "target", CFG).orderBy("month_start").collect()
    assert [r["label"] for r in rows] == [*range(3, 20), 23, 24]
    for r in rows:
        assert [x[0] for x in r["window"]] == [r["label"] - k for k in (3, 2, 1)]
    out = {r["target"]: r["scaled_target"] for r in scaled.collect()}
    assert out[0.0] == 0.0 and out[19.0] == 1.0 and out[24.0] > 1.0


def test_constant_column_scales_to_zero(spark):
    p = panel_of(spark, {1: np.full(10, 7.0)})
    scaled = sequence.scaled_panel(p, ["target"], CFG)
    assert {r["scaled_target"] for r in scaled.collect()} == {0.0}


class Guess:
    def __init__(self, value):
        self.value = value

    def transform(self, df):
        return df.withColumn("prediction", F.lit(self.value).cast("double"))


def test_sequence_candidates(spark):
    columns = "actual double, range_target double, low_target double"
    check = spark.createDataFrame([(10.0, 10.0, 0.0), (20.0, 10.0, 10.0), (0.0, 1.0, 0.0)], columns)
    models = [Guess(float("nan")), Guess(0.5), Guess(1.0), Guess(1.0), Guess(None)]
    scores = sequence.candidate_scores(check, models)
    maes = [r["MAE"] for r in scores.orderBy("candidate").collect()]
    assert maes == [None, pytest.approx(10.5 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), None]
    assert sequence.best_candidate(scores) == 2
    assert sequence.best_candidate(sequence.candidate_scores(check.limit(0), models)) is None
    assert sequence.best_candidate(sequence.candidate_scores(check, models[:1])) is None


def test_sequence_selection_rows(spark):
    p = panel_of(spark, {1: np.arange(25.0)})
    windows = sequence.train_windows(p, ["target"], CFG)
    fit, check = sequence.selection_rows(windows, p, CFG)
    assert sorted(r["actual"] for r in check.collect()) == [23, 24]
    assert sorted(r["actual"] for r in fit.collect()) == [*range(3, 20)]
    fit, check = sequence.selection_rows(windows, p, replace(CFG, seq_selection="validation"))
    assert sorted(r["actual"] for r in check.collect()) == [*range(16, 20)]
    assert sorted(r["actual"] for r in fit.collect()) == [*range(3, 16)]


def test_sequence_forecast(spark):
    cfg = replace(SMALL, seq_selection="validation")
    p = panel_of(spark, {1: seasonal(40), 2: np.full(40, 9.0), 3: np.zeros(40)})
    result = sequence.forecast_sequences(p, ["g_month"], "seq", cfg)
    rows = result.forecasts.collect()
    assert len(rows) == 12 and {r["product_code"] for r in rows} == {1, 2}
    assert all(r["forecast"] >= 0 for r in rows)
    assert {r["product_code"] for r in result.by_product.collect()} == {1, 2}
    assert result.overall.count() == 1
    short = panel_of(spark, {1: np.arange(6.0)})
    assert sequence.forecast_sequences(short, ["g_month"], "seq", cfg) is None


def test_model_codes():
    assert model_codes(["XGB", "RF"]) == ["gbt", "rf"]
    assert model_codes("all") == ["rf", "gbt", "trend", "sarima", "seq"]
    assert model_codes(["Bi-LSTM", "seq", "Prophet"]) == ["seq", "trend"]
    with pytest.raises(ValueError, match="unknown"):
        model_codes(["other"])


def test_whole_run_writes_every_sheet(spark, tmp_path):
    raw = stock_view.raw_transactions(spark, SF, labels=True).drop("seq")
    raw = raw.withColumn("seq", F.monotonically_increasing_id())
    calendar = parse_working_days(stock_view.working_days(spark, SF))
    cfg = replace(SMALL, gbt_depths=(3,), gbt_rounds=(5,), rf_depths=(3,), rf_trees=5)
    out = run(raw, calendar, cfg, ["XGB", "Prophet"], str(tmp_path), headers=True)
    assert out.quarantine.isEmpty() and not out.skipped
    names = {p.name for p in tmp_path.iterdir()}
    assert names == {
        "PowerBI_Data", "ABC_Analysis", "Total_Forecast", "ML_Product_Forecast",
        "All_Products_Forecast", "Model_Evaluation", "Feature_Importance", "Label_Dictionary",
        "Quarantine", "Undated", "Input_Summary", "Renamed_Products", "Skipped_Series",
    }
    sheet = spark.read.parquet(str(tmp_path / "ABC_Analysis"))
    assert sheet.exceptAll(persian_headers(abc_export(out.enriched))).isEmpty()
    assert sheet.count() == abc_export(out.enriched).count()
    assert spark.read.parquet(str(tmp_path / "Input_Summary")).first()["rows"] == 6000
    rows = spark.read.parquet(str(tmp_path / "PowerBI_Data"))
    assert rows.count() == 6000
    assert {"کد کالا", "کلاس ABC", "ماه شمسی", "original_qty"} <= set(rows.columns)
    total = spark.read.parquet(str(tmp_path / "Total_Forecast")).toPandas()
    assert set(total["Model Name"]) == {"Actual", "Gradient Boosting", "Trend Seasonal"}
    assert (total[total["Model Name"] != "Actual"].groupby("Model Name").size() == 6).all()
    scores = spark.read.parquet(str(tmp_path / "Model_Evaluation")).toPandas()
    assert set(scores["Model"]) == {"Gradient Boosting", "Trend Seasonal"}
    assert np.allclose(scores["RMSE"] ** 2, scores["MSE"])


def test_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    """A run that fails in its second model keeps the first; other settings find nothing."""
    raw = stock_view.raw_transactions(spark, SF, labels=True).where("seq.l_orderkey % 4 = 0").drop("seq")
    raw = raw.withColumn("seq", F.monotonically_increasing_id())
    calendar = parse_working_days(stock_view.working_days(spark, SF))
    cfg = replace(SMALL, rf_depths=(2,), rf_trees=3, importance_trees=3, importance_rounds=2)
    stages, calls = str(tmp_path / "stages"), []
    mean = type("Mean", (), {"transform": lambda self, df: df.withColumn("prediction", F.col("rolling_mean_3"))})
    monkeypatch.setattr(whole, "predictor", lambda model: model.transform)

    def fit(code, fails=False):
        def fitter(train, features, cfg):
            calls.append(code)
            if fails:
                raise RuntimeError("lost")
            return mean()

        return fitter

    monkeypatch.setattr(whole, "FITTERS", {"rf": fit("rf"), "gbt": fit("gbt", fails=True)})
    with pytest.raises(RuntimeError, match="lost"):
        run(raw, calendar, cfg, ["rf", "gbt"], stages_dir=stages)
    monkeypatch.setattr(whole, "FITTERS", {"rf": fit("rf"), "gbt": fit("gbt")})
    monkeypatch.setattr(whole, "importance_table", lambda *a: pytest.fail("made twice"))
    out = run(raw, calendar, cfg, ["rf", "gbt"], stages_dir=stages)
    assert calls == ["rf", "gbt", "gbt"]
    assert {r["Model"] for r in out.sheets["Model_Evaluation"].collect()} == {"Random Forest", "Gradient Boosting"}
    products = raw.select("product_code").distinct().count()
    assert out.sheets["All_Products_Forecast"].count() == 2 * 6 * products
    kept = spark.read.parquet(f"{stages}/manifest")
    assert sorted(r["stage"] for r in kept.collect()) == ["gbt", "importance", "rf"]
    key = kept.first()["fingerprint"]
    assert Stages(spark, stages, key).done and not Stages(spark, stages, "other").done


def test_fingerprint_follows_rows_and_settings(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    same = fingerprint({"t": df.repartition(3)}, CFG)
    assert same == fingerprint({"t": df.orderBy(F.desc("x")).select("y", "x")}, CFG)
    assert same == fingerprint({"t": df}, CFG)
    assert same != fingerprint({"t": df.distinct()}, CFG)
    assert same != fingerprint({"t": df}, replace(CFG, seed=1))


def test_job_on_csv_files(spark, tmp_path):
    lines = [" تاریخ ,کد کالا,مقدار (اصلی),نام کالا,انبار"]
    for year in (1401, 1402):
        for m in range(1, 13):
            lines += [f"{year}/{m:02d}/10,{p},{10 * p + m},name {p},w{p}" for p in (1, 2)]
    lines += ["1402/13/01,1,5,name 1,w1", "1402/12/10,x,5,name 1,w1", ",1,5,other,w1"]
    (tmp_path / "tx.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "days.csv").write_text("Date,WorkingDay\n01/04/2022,1\n")
    out = tmp_path / "out"
    main(["--transactions", str(tmp_path / "tx.csv"), "--format", "csv", "--calendar", str(tmp_path / "days.csv"),
          "--out", str(out), "--models", "SARIMA", "trend"])
    names = {p.name for p in out.iterdir()}
    assert names == {
        "PowerBI_Data", "ABC_Analysis", "Total_Forecast", "Model_Evaluation", "Feature_Importance",
        "Label_Dictionary", "Quarantine", "Undated", "Input_Summary", "Renamed_Products", "Skipped_Series",
    }
    summary = spark.read.parquet(str(out / "Input_Summary")).first().asDict()
    assert summary == {"rows": 51, "fractional_rows": 0, "rows_without_code": 1, "rows_without_date": 1, "undated_rows": 2}
    reasons = [r["reason"] for r in spark.read.parquet(str(out / "Undated")).collect()]
    assert sorted(reasons) == ["no date", "not a valid date"]
    assert spark.read.parquet(str(out / "Quarantine")).count() == 1
    assert spark.read.parquet(str(out / "PowerBI_Data")).count() == 49
    with pytest.raises(SystemExit):
        arguments(["--transactions", "a", "--calendar", "b", "--out", "c", "--models", "other"])


def test_registered_model_queries_use_the_shipped_grids(monkeypatch):
    seen = []
    monkeypatch.setattr(spark_queries.whole, "run", lambda raw, calendar, cfg, models: seen.append(cfg))
    monkeypatch.setattr(spark_queries.stock_view, "raw_transactions", lambda *a, **k: None)
    monkeypatch.setattr(spark_queries.stock_view, "working_days", lambda *a, **k: None)
    monkeypatch.setattr(spark_queries, "parse_working_days", lambda *a: None)
    spark_queries._run(None, SF, "all")
    fits = {"rf": lambda train, names, cfg: seen.append(cfg)}
    monkeypatch.setattr(spark_queries, "cached", lambda *a: (None, [], type("Facts", (), {"products": None})))
    monkeypatch.setattr(spark_queries.split, "add_folds", lambda *a: None)
    monkeypatch.setattr(spark_queries.whole, "FITTERS", fits)
    spark_queries.fitted("rf", None, SF)
    assert [replace(cfg, report_from_year=CFG.report_from_year) for cfg in seen] == [CFG, CFG]


def test_booster_search_scores_shorter_fits_from_the_longest(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(3 * a - b * b + rng.normal(0, 0.3)), i * 3 // 300)
            for i, (a, b) in enumerate(rng.random((300, 2)) * 4)]
    train = spark.createDataFrame(rows, "a double, b double, target double, fold int").coalesce(1)
    cfg = replace(CFG, gbt_rounds=(3, 9), gbt_depths=(2, 3), gbt_rates=(0.1, 1.0), gbt_leaf_rows=(1,), max_bins=16)
    rows = tree.assembler(["a", "b"]).transform(train).cache()
    gbt = tree.booster(cfg)
    grid = (
        ParamGridBuilder().addGrid(gbt.maxIter, cfg.gbt_rounds).addGrid(gbt.maxDepth, cfg.gbt_depths)
        .addGrid(gbt.stepSize, cfg.gbt_rates).addGrid(gbt.minInstancesPerNode, cfg.gbt_leaf_rows).build()
    )
    one_by_one, shared = tree.search(gbt, grid, rows, cfg), tree.search_booster(gbt, rows, cfg)
    assert shared.toDebugString.split("\n")[1:] == one_by_one.toDebugString.split("\n")[1:]
    assert shared.getNumTrees == one_by_one.getNumTrees
