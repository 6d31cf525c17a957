"""Series fitted side by side against the same series fitted one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.models import series
from catalog import spark_queries as catalog
from tests.test_models import panel_of
from tests.test_scale_queries import cached_frames, tables  # noqa: F401

RNG = np.random.default_rng(5)
KINDS = {
    "sparse": RNG.poisson(0.4, (30, 66)) * RNG.integers(1, 50, (30, 66)).astype(float),
    "seasonal": RNG.gamma(2, 20, (20, 66)) + 30 * np.sin(np.arange(66) * np.pi / 6),
    "constant": np.repeat(np.arange(5.0)[:, None], 66, 1),
    "one sale": np.eye(66)[:20] * 20,
}
CANDIDATES = {
    series.trend_forecast_of: [{"prior": p, "mode": m} for p in series.TREND_PRIORS for m in series.TREND_MODES],
    series.sarima_forecast_of: [
        {"regular": list(o), "seasonal": list(s)} for o in series.ARIMA_ORDERS for s in series.SEASONAL_ORDERS
    ],
}


def alone(fit, y, candidate):
    try:
        return fit(y, 8, candidate)
    except (ValueError, np.linalg.LinAlgError):
        return None


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("fit", CANDIDATES)
def test_side_by_side_equals_one_by_one(kind, fit):
    for months in (66, 20, 9):
        rows = KINDS[kind][:, :months]
        for candidate in CANDIDATES[fit]:
            for y, got in zip(rows, series.fitted_rows(fit, list(rows), 8, candidate), strict=True):
                want = alone(fit, y, candidate)
                assert (want is None) == (got is None)
                if want is not None:
                    assert np.allclose(got, want, rtol=1e-6, atol=1e-6)


def test_invertible_rows_equal_single_ones():
    lags = [1, 12, 13]
    theta = RNG.normal(0, 0.6, (200, 3))
    want = [series.invertible(t, lags) for t in theta]
    assert series.invertible_many(theta, lags).tolist() == want and 20 < sum(want) < 180


def test_series_are_not_copied_for_their_candidates(spark, monkeypatch):
    """What is written on the way has a row per series, and nothing crosses an exchange twice."""
    kept = []
    write = series.stored
    monkeypatch.setattr(series, "stored", lambda df, key=None: kept.append(write(df, key)) or kept[-1])
    p = panel_of(spark, {i: KINDS["sparse"][i] for i in range(8)})
    result = series.forecast_series(p, "sarima", "m", Config(), ["product_code"])
    assert result.forecasts.count() == 8 * Config().horizon
    assert [df.count() for df in kept] == [8, 8]
    scores = series.candidate_scores(p, "sarima", Config(), ["product_code"])
    assert scores.count() == 8 * 12 and scores.where(F.col("mae").isNull()).isEmpty()


@pytest.mark.parametrize("name", ["trend_forecast_by_product", "sarima_forecast"])
def test_registered_series_queries_cache_no_panel(spark, tables, name):  # noqa: F811
    before = cached_frames(spark)
    assert catalog.QUERIES[name](spark, tables).count() in (6, 12 * 6)
    assert cached_frames(spark) == before
