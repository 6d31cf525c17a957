"""The registered Spark queries, each over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.config import ABC_EXPORT_COLUMNS, CANONICAL_TO_PERSIAN, MODEL_NAMES, Config
from anbar.functions import jalali
from anbar.functions.numbers import half_even
from anbar.functions.text import ARABIC_DIGITS, ascii_digits, number_from_text, persian_digits
from anbar.models import sequence, series, tree
from anbar.operators import abc, cleaning, features, forecast, metrics, outliers, report, split
from anbar.operators import panel as panels
from anbar.plans import run as whole
from anbar.plans.session import cut_lineage, ensure_checkpoint_dir, stored
from anbar.sources import stock_view
from anbar.sources.sinks import write_bi_export, write_forecast_report, write_sheet
from anbar.sources.tables import parse_working_days, read_transactions

CFG = Config()

REPORT = replace(CFG, report_from_year=1379)
SEQUENCE_FEATURES = ["lag_1", "g_month"]


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), places) for c in columns})


def dated(spark, sf, variant="plain", labels=False) -> DataFrame:
    typed = cleaning.type_values(
        cleaning.rename_columns(stock_view.raw_transactions(spark, sf, variant, labels))
    )
    return cleaning.drop_undated(cleaning.add_dates(typed, CFG))


def prepared(spark, sf, variant="plain", labels=False) -> DataFrame:
    calendar = parse_working_days(stock_view.working_days(spark, sf))
    return cleaning.add_working_days(dated(spark, sf, variant, labels), calendar, CFG)


def build(spark, sf, variant="plain") -> panels.Panel:
    return panels.build_panel(prepared(spark, sf, variant), CFG)


def featured(panel: panels.Panel) -> tuple[panels.Panel, list[str]]:
    names = features.feature_candidates(panel.frame)
    return panel._replace(frame=features.as_features(panel.frame, names)), names


def cached(spark, sf) -> tuple[panels.Panel, list[str], panels.Facts]:
    """Panel for the model queries, which read it many times."""
    f = panels.facts(prepared(spark, sf), CFG)
    panel, names = whole.cached_panel(f, CFG)
    return panel, names, f


def finished(panel: panels.Panel, result: DataFrame) -> DataFrame:
    """Keep the (small) result, give the panel's cache back."""
    kept = cut_lineage(result)
    panel.frame.unpersist()
    return kept


# --- cleaning and calendar --------------------------------------------------


def digits_numeric(spark, sf):
    line = F.col("l_linenumber")
    plain = F.format_number("l_extendedprice", 2)
    text = (
        F.when(line % 3 == 0, F.translate(plain, "0123456789", ARABIC_DIGITS))
        .when(line % 2 == 0, persian_digits(plain))
        .otherwise(plain)
    )
    text = F.when(line == 7, F.concat(text, F.lit("d"))).otherwise(F.concat(F.lit(" "), text))
    rows = stock_view.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("text")
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        ascii_digits(F.col("text")).alias("digits"),
        number_from_text(F.col("text")).alias("value"),
    )


def label_codes(spark, sf):
    cleaned = cleaning.clean_labels(stock_view.raw_transactions(spark, sf, labels=True))
    return cleaning.label_dictionary(cleaned)


def clean_transactions(spark, sf):
    raw = stock_view.raw_transactions(spark, sf, labels=True)
    cleaned, _ = cleaning.clean_transactions(raw, CFG)
    return cleaned.select(
        F.col("seq.l_orderkey").alias("l_orderkey"), "product_code", "product_name", "qty",
        *cleaning.LABEL_COLUMNS,
    )


def jalali_dates(spark, sf):
    return dated(spark, sf).select(
        "product_code", "jalali_date", "gregorian_date", "jalali_year", "jalali_month",
        "jalali_month_name", "jalali_day", "jalali_season", "g_year", "g_month", "g_day",
        "g_weekday", "month_start",
    )


def month_features(spark, sf):
    first, last = F.min("month_start").alias("first"), F.max("month_start").alias("last")
    bounds = dated(spark, sf).agg(first, last).where("first is not null")
    known = panels.month_array(F.col("first"), F.col("last"))
    months = F.concat(known, jalali.future_months(F.col("last"), CFG.horizon))
    rows = bounds.select("last", F.explode(months).alias("month_start"))
    out = jalali.with_month_features(rows, "month_start")
    return out.withColumn("is_future", F.col("month_start") > F.col("last")).drop("last")


def working_day_calendar(spark, sf):
    return parse_working_days(stock_view.working_days(spark, sf))


def working_day_join(spark, sf):
    return prepared(spark, sf).select("product_code", "qty", "gregorian_date", "working_day")


def dirty(spark, sf) -> DataFrame:
    """All lines as documents with faults, typed and dated."""
    raw = cleaning.rename_columns(stock_view.dirty_transactions(spark, sf))
    return cleaning.add_dates(cleaning.type_values(raw), CFG)


def raw_cleaned(spark, sf):
    return dirty(spark, sf).select("seq.*", "product_code", "product_name", "qty")


def csv_reader(spark, sf):
    """All lines as CSV files under Persian headers, read by the reader and typed."""
    path = f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4()}"
    rows = stock_view.dirty_transactions(spark, sf)
    rows.select("seq.*", *[f"`{c}`" for c in rows.columns if c != "seq"]).write.option("header", True).csv(path)
    read = cleaning.type_values(cleaning.rename_columns(read_transactions(spark, path, "csv")))
    keys = [F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int")]
    return read.select(*keys, "product_code", "product_name", "qty")


def raw_dates(spark, sf):
    return dirty(spark, sf).select(
        "seq.*", "gregorian_date", "jalali_year", "jalali_month", "jalali_day", "g_weekday"
    )


def raw_winsorized(spark, sf):
    rows = outliers.winsorize(cleaning.drop_undated(dirty(spark, sf)), CFG)
    return rows.select("seq.*", "product_code", "original_qty", "qty")


def quarantine_rows(spark, sf):
    return cleaning.quarantine(dirty(spark, sf)).select("seq.*", "qty", "jalali_date")


def undated_rows(spark, sf):
    return cleaning.undated(dirty(spark, sf)).select("seq.*", "reason")


def input_summary(spark, sf):
    return cleaning.input_summary(dirty(spark, sf))


# --- outliers and ABC -------------------------------------------------------


def quantity_bounds(spark, sf):
    return rounded(outliers.quantity_bounds(dated(spark, sf), CFG), 6, "low", "high")


def winsorized(variant):
    def query(spark, sf):
        return outliers.winsorize(dated(spark, sf, variant), CFG).select(
            "product_code", "gregorian_date", "original_qty", "qty"
        )

    return query


def monthly_consumption(spark, sf):
    return abc.monthly_consumption(outliers.winsorize(dated(spark, sf), CFG))


def abc_monthly(variant):
    def query(spark, sf):
        return abc.monthly_abc(outliers.winsorize(dated(spark, sf, variant), CFG), CFG)

    return query


def abc_enriched(spark, sf):
    return abc.enrich(prepared(spark, sf), CFG).drop("seq")


def abc_export(spark, sf):
    return abc.abc_export(abc.enrich(dated(spark, sf), CFG))


def abc_sheet(spark, sf):
    """The sheet that a run writes, from product-month facts, written and read back."""
    f = panels.facts(prepared(spark, sf), CFG)
    path = f"{ensure_checkpoint_dir(spark)}/abc-sheet-{uuid.uuid4()}"
    write_sheet(abc.abc_sheet(f.months, f.abc), path, headers=True)
    names = {CANONICAL_TO_PERSIAN.get(c, c): c for c in ABC_EXPORT_COLUMNS}
    return spark.read.parquet(path).withColumnsRenamed(names)


def bi_export(spark, sf):
    """The transaction export with label codes, written and read back."""
    raw = stock_view.raw_transactions(spark, sf, labels=True)
    calendar = parse_working_days(stock_view.working_days(spark, sf))
    rows, _ = cleaning.prepare(raw, calendar, CFG)
    out_dir = f"{ensure_checkpoint_dir(spark)}/bi-export-{uuid.uuid4()}"
    paths = write_bi_export(abc.enrich(rows, CFG).drop("seq"), out_dir)
    return spark.read.parquet(paths["PowerBI_Data"]).drop("year_part")


# --- panel ------------------------------------------------------------------


def panel_grid(spark, sf):
    cells = stored(panels.sales_cells(dated(spark, sf)), "product_code")
    cells = cells.where(F.col("product_code").isNotNull())
    first, last = panels.month_bounds(cells)
    return panels.grid(panels.product_names(cells), first, last)


def panel_agg(spark, sf):
    return panels.facts(prepared(spark, sf), CFG).monthly


def panel_full(variant):
    def query(spark, sf):
        return rounded(build(spark, sf, variant).frame, 6, "rolling_mean_3", "rolling_std_3")

    return query


def panel_lags(spark, sf):
    return build(spark, sf).frame.select(
        "product_code", "month_start", "target", "lag_1", "lag_2", "lag_3"
    )


def panel_rolling(spark, sf):
    rows = build(spark, sf).frame.select(
        "product_code", "month_start", "target", "rolling_mean_3", "rolling_std_3"
    )
    return rounded(rows, 6, "rolling_mean_3", "rolling_std_3")


def total_series(spark, sf):
    return panels.total_series(build(spark, sf).frame).orderBy("month_start")


# --- split, metrics, features -----------------------------------------------


def time_split(spark, sf):
    marked = split.mark_split(build(spark, sf), CFG)
    return marked.groupBy("split", "month_start").agg(
        F.count("*").alias("rows"), F.sum("target").alias("target")
    )


def cv_folds(spark, sf):
    f = panels.facts(prepared(spark, sf), CFG)
    panel = panels.panel_from_facts(f, CFG)
    return split.add_folds(panel, f.products, CFG).select("product_code", "month_start", "fold")


def feature_corr(spark, sf):
    panel, names = featured(build(spark, sf))
    return features.correlations(panel.frame, names)


def feature_rows(spark, sf) -> tuple[DataFrame, list[str]]:
    """Features and target alone, stored: they are read several times."""
    panel, names = featured(build(spark, sf))
    return stored(panel.frame.select(*names, "target")), names


def feature_mi(spark, sf):
    rows, names = feature_rows(spark, sf)
    return features.mutual_information(rows, names, CFG)


def top_features(spark, sf):
    rows, names = feature_rows(spark, sf)
    scores = features.correlations(rows, names).join(features.mutual_information(rows, names, CFG), "Feature")
    return features.top_features(scores, CFG)


def naive_eval(spark, sf):
    _, test = split.split_panel(build(spark, sf), CFG)
    return rounded(metrics.evaluate(test, "target", "lag_1"), 4, *metrics.METRICS)


def naive_eval_by_product(spark, sf):
    _, test = split.split_panel(build(spark, sf), CFG)
    rows = metrics.evaluate(test, "target", "lag_1", ["product_code"])
    return rounded(rows, 4, *metrics.METRICS)


# --- forecasts and reports --------------------------------------------------


def live_products(spark, sf):
    return forecast.live_products(build(spark, sf, "returns").frame)


def last_state(spark, sf):
    panel, _ = featured(build(spark, sf, "returns"))
    rows = forecast.last_state(panel, ["month_txn_count", "abc_encoded"])
    return rows.select(
        "product_code", "product_name", "month_txn_count", "abc_encoded",
        *[F.col(forecast.past(i)).alias(f"target_{i}") for i in range(3)],
    )


def mean_predictor(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.col("rolling_mean_3"))


def mean_forecast(spark, sf, variant="plain") -> tuple[panels.Panel, DataFrame]:
    panel, _ = featured(build(spark, sf, variant))
    return panel, forecast.recursive_forecast(panel, mean_predictor, "Rolling Mean", CFG)


def recursive_mean_forecast(spark, sf):
    return rounded(mean_forecast(spark, sf, "returns")[1], 6, "forecast")


def total_forecast_sheet(spark, sf):
    panel, rows = mean_forecast(spark, sf)
    totals = forecast.monthly_totals(rows)
    sheet = report.total_forecast_sheet(panels.total_series(panel.frame), totals, REPORT)
    return rounded(report.ordered_sheet(sheet), 4, "Forecasting Value")


def product_sheet(spark, sf):
    rows = mean_forecast(spark, sf)[1]
    return rounded(report.product_sheet(rows), 6, "Forecasting Value")


def minmax_scaled(spark, sf):
    names = ["lag_1", "rolling_mean_3", "target"]
    scaled = sequence.scaled_panel(build(spark, sf), names, CFG)
    columns = [f"scaled_{c}" for c in names]
    return rounded(scaled.select("product_code", "month_start", "split", *columns), 6, *columns)


def sequences(spark, sf):
    names = [*SEQUENCE_FEATURES, "target"]
    scaled = sequence.scaled_panel(build(spark, sf), names, CFG)
    windows = sequence.sequences(
        scaled, [f"scaled_{c}" for c in SEQUENCE_FEATURES], "scaled_target", CFG
    )
    rows = windows.select(
        "product_code", "month_start", "split", "label", F.posexplode("window").alias("pos", "x")
    )
    flat = rows.select(
        "product_code", "month_start", "split", "label", "pos",
        *[F.col("x")[i].alias(c) for i, c in enumerate(SEQUENCE_FEATURES)],
    )
    return rounded(flat, 6, "label", *SEQUENCE_FEATURES)


# --- fitted models (no SQL twin) --------------------------------------------


def fitted(code, spark, sf):
    panel, names, f = cached(spark, sf)
    train = split.add_folds(panel, f.products, REPORT)
    model = whole.FITTERS[code](train, names, REPORT)
    return panel, model


def grid_eval(code):
    def query(spark, sf):
        panel, model = fitted(code, spark, sf)
        _, test = split.split_panel(panel, REPORT)
        scores = model.transform(test)
        return finished(
            panel, metrics.model_row(scores, "target", "prediction", MODEL_NAMES[code])
        )

    return query


def tree_forecast(spark, sf):
    panel, model = fitted("rf", spark, sf)
    rows = forecast.recursive_forecast(panel, tree.predictor(model), MODEL_NAMES["rf"], REPORT)
    return finished(panel, rows)


def series_forecast(code, keys=()):
    def query(spark, sf):
        # The series are read from the panel once: there is nothing to cache.
        result = series.forecast_series(build(spark, sf), code, MODEL_NAMES[code], REPORT, keys)
        return result.forecasts

    return query


def sarima_ar_scores(spark, sf):
    """Holdout error per product of the two candidates that are plain autoregressions."""
    panel, _ = featured(build(spark, sf))
    scores = series.candidate_scores(panel, "sarima", CFG, ["product_code"])
    seasonal = F.aggregate("candidate.seasonal", F.lit(0), lambda a, x: a + x.cast("int"))
    regular = F.array_join(F.transform("candidate.regular", lambda x: x.cast("string")), ",")
    rows = scores.where(seasonal == 0).select("product_code", regular.alias("order"), "mae")
    return rounded(rows.where(F.col("order").isin("1,0,0", "1,1,0")), 4, "mae")


def last_value_predictor(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.col("lag_1"))


def report_sheets(spark, sf):
    """Two closed-form models through product sheets, the model filter, the union and the
    evaluation, written as a report and read back."""
    panel, _ = featured(build(spark, sf))
    panel = panel._replace(frame=panel.frame.persist())
    models = {"Rolling Mean": mean_predictor, "Last Value": last_value_predictor}
    forecasts = [forecast.recursive_forecast(panel, m, n, CFG) for n, m in models.items()]
    every = cleaning.union_all(forecasts)
    _, test = split.split_panel(panel, CFG)
    scores = [
        metrics.model_row(m(test), "target", "prediction", n).select("Model", *metrics.METRICS)
        for n, m in models.items()
    ]
    sheets = {
        "ML_Product_Forecast": report.product_sheet(report.of_models(every, ["Last Value"])),
        "All_Products_Forecast": report.product_sheet(every),
        "Sequence_Product_Forecast": report.product_sheet(report.of_models(every, ["none"])),
        "Model_Evaluation": cleaning.union_all(scores),
    }
    out_dir = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4()}"
    paths = write_forecast_report(sheets, out_dir)
    panel.frame.unpersist()
    parts = []
    for name, path in paths.items():
        rows = spark.read.parquet(path)
        if name == "Model_Evaluation":
            pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in metrics.METRICS]
            rows = rows.select(F.col("Model").alias("model"), F.inline(F.array(*pairs)))
            part = rows.groupBy("model", "measure").agg(F.sum("value").alias("value"))
            part = part.withColumn("rows", F.lit(1).cast("long"))
        else:
            part = rows.groupBy(
                F.col("Model Name").alias("model"), F.col("jalali_month").alias("measure")
            ).agg(F.sum("Forecasting Value").alias("value"), F.count("*").alias("rows"))
        parts.append(part.select(F.lit(name).alias("sheet"), "model", "measure", "value", "rows"))
    return rounded(cleaning.union_all(parts), 4, "value")


def seq_forecast(spark, sf):
    panel, names, _ = cached(spark, sf)
    result = sequence.forecast_sequences(panel, names, MODEL_NAMES["seq"], REPORT)
    return finished(panel, result.forecasts)


class WindowMean:
    """Predicts the mean of the scaled window, in place of a fitted model."""

    def transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array("features")
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return df.withColumn("prediction", total / F.size(values))


def seq_rollout_mean(spark, sf):
    """The recursive rollout of scaled windows with a closed-form model."""
    panel, _ = featured(build(spark, sf))
    rows = sequence.rollout(panel, ["lag_1"], WindowMean(), "Window Mean", CFG)
    return rounded(rows, 4, "forecast")


class WindowElement:
    """Predicts one element of the window, after sorting it if asked."""

    def __init__(self, place: int, ordered: bool = False):
        self.place, self.ordered = place, ordered

    def transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array("features")
        values = F.array_sort(values) if self.ordered else values
        return df.withColumn("prediction", F.element_at(values, self.place))


def seq_choice(spark, sf):
    """The choice among candidates on test windows and on validation windows, with
    closed-form models: mean, last and middle value of the window."""
    panel, _ = featured(build(spark, sf, "returns"))
    live = sequence.eligible(panel)
    windows = cut_lineage(sequence.train_windows(live, ["lag_1"], CFG))
    models = [WindowMean(), WindowElement(-1), WindowElement(2, ordered=True)]
    parts = []
    for selection in ("test", "validation"):
        _, check = sequence.selection_rows(windows, live, replace(CFG, seq_selection=selection))
        scores = sequence.candidate_scores(check, models)
        chosen = F.col("candidate").eqNullSafe(F.lit(sequence.best_candidate(scores)))
        parts.append(scores.select(F.lit(selection).alias("selection"), "candidate", "MAE", chosen.alias("chosen")))
    return rounded(cleaning.union_all(parts), 4, "MAE")


def importance_table(spark, sf):
    panel, names, _ = cached(spark, sf)
    return finished(panel, tree.importance_table(panel.frame, names, REPORT))


def model_evaluation(spark, sf):
    return _run(spark, sf, ("gbt", "rf", "trend", "sarima")).sheets["Model_Evaluation"]


def full_run(spark, sf):
    return _run(spark, sf, "all").sheets["All_Products_Forecast"]


def _run(spark, sf, models):
    raw = stock_view.raw_transactions(spark, sf, labels=True)
    calendar = parse_working_days(stock_view.working_days(spark, sf))
    return whole.run(raw, calendar, REPORT, models)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "digits_numeric": digits_numeric,
    "label_codes": label_codes,
    "clean_transactions": clean_transactions,
    "jalali_dates": jalali_dates,
    "month_features": month_features,
    "working_day_calendar": working_day_calendar,
    "working_day_join": working_day_join,
    "quantity_bounds": quantity_bounds,
    "winsorized_qty": winsorized("plain"),
    "winsorized_small_groups": winsorized("small"),
    "raw_cleaned": raw_cleaned,
    "csv_reader": csv_reader,
    "raw_dates": raw_dates,
    "raw_winsorized": raw_winsorized,
    "quarantine_rows": quarantine_rows,
    "undated_rows": undated_rows,
    "input_summary": input_summary,
    "winsorized_returns": winsorized("returns"),
    "monthly_consumption": monthly_consumption,
    "abc_monthly": abc_monthly("plain"),
    "abc_monthly_returns": abc_monthly("returns"),
    "abc_enriched": abc_enriched,
    "abc_export": abc_export,
    "abc_sheet": abc_sheet,
    "bi_export": bi_export,
    "panel_grid": panel_grid,
    "panel_agg": panel_agg,
    "panel_full": panel_full("plain"),
    "panel_returns": panel_full("returns"),
    "panel_lags": panel_lags,
    "panel_rolling": panel_rolling,
    "total_series": total_series,
    "time_split": time_split,
    "cv_folds": cv_folds,
    "feature_corr": feature_corr,
    "feature_mi": feature_mi,
    "top_features": top_features,
    "naive_eval": naive_eval,
    "naive_eval_by_product": naive_eval_by_product,
    "live_products": live_products,
    "last_state": last_state,
    "recursive_mean_forecast": recursive_mean_forecast,
    "total_forecast_sheet": total_forecast_sheet,
    "product_sheet": product_sheet,
    "minmax_scaled": minmax_scaled,
    "sequences": sequences,
    "rf_grid": grid_eval("rf"),
    "gbt_grid": grid_eval("gbt"),
    "tree_forecast": tree_forecast,
    "trend_forecast": series_forecast("trend"),
    "sarima_forecast": series_forecast("sarima"),
    "sarima_forecast_by_product": series_forecast("sarima", ("product_code",)),
    "sarima_ar_scores": sarima_ar_scores,
    "report_sheets": report_sheets,
    "trend_forecast_by_product": series_forecast("trend", ("product_code",)),
    "seq_forecast": seq_forecast,
    "seq_rollout_mean": seq_rollout_mean,
    "seq_choice": seq_choice,
    "importance_table": importance_table,
    "model_evaluation": model_evaluation,
    "full_run": full_run,
}
