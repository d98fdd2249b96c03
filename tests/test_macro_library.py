"""The library of macro candidates against plain computations."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from riskpanel.operators import macro_library as ml
from riskpanel.operators.macro_severity import rank_correlations

MONTHS = [d.date() for d in pd.date_range("2001-01-01", periods=60, freq="MS")]
CANDIDATE = "candidate string, key string, transform string, lag int, month date, value double"


def series(key, values, lag=0):
    return [(f"{key}@level@{lag}", key, "level", lag, m, None if v is None else float(v)) for m, v in zip(MONTHS, values, strict=False)]


@pytest.mark.parametrize("statistic, p", [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)])
def test_unit_root_p_at_critical_values(statistic, p):
    assert ml.unit_root_p(statistic) == pytest.approx(p, abs=0.002)


def test_unit_root_p_rises_and_ends():
    found = [ml.unit_root_p(x) for x in np.linspace(-20, 4, 200)]
    assert found[0] == 0 and found[-1] == 1 and all(a <= b + 1e-3 for a, b in zip(found, found[1:], strict=False))


def test_unit_roots(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=60)
    rows = series("noise", noise) + series("walk", np.cumsum(noise)) + series("flat", [2.0] * 60) + series("short", noise[:20])
    found = {r.candidate.split("@")[0]: r for r in ml.unit_roots(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert found["noise"].stationary and found["noise"].adf_p < 0.01
    assert not found["walk"].stationary and found["walk"].adf_p > 0.05
    assert all(found[k][c] is None for k in ("flat", "short") for c in ("adf", "adf_lags", "adf_p", "stationary"))
    assert ml.unit_roots(spark.createDataFrame([], CANDIDATE)).count() == 0


def test_expected_signs(spark):
    keys = spark.createDataFrame([("rate",), ("prices",), ("rents_yoy",), ("other",), (None,)], "key string")
    signs = lambda priors: [r[0] for r in keys.select(ml.expected_sign(keys["key"], priors)).collect()]
    assert signs({"rate": 1, "prices_growth": -1, "rents": -1}) == [1, -1, -1, None, None]
    assert signs({}) == [None] * 5


def test_library(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=40).cumsum() * 0.1 - 3
    x = [*(y[:40] + rng.normal(size=40) * 0.2), *[9.0] * 20]  # months after the window don't count
    gaps = [None if i % 2 else v for i, v in enumerate(x)]
    rows = series("rate", x) + series("flat", [1.0] * 60) + series("gaps", gaps) + series("odd", [math.nan if i == 3 else v for i, v in enumerate(x)])
    target = spark.createDataFrame([(m, 600, float(v)) for m, v in zip(MONTHS, y, strict=False)], "month date, n long, y double")
    severity = [(m, float(s), 1) for i, m in enumerate(MONTHS[:40]) for s in (0.2 + i * 0.01, 0.3 + i * 0.01)]
    counts = spark.createDataFrame(severity, "month date, severity double, n long")
    found = {r.key: r for r in ml.library(spark.createDataFrame(rows, CANDIDATE), target, counts, {"rate_yoy": -1, "odd": 1}).collect()}
    assert set(found) == {"rate", "flat", "odd"}  # gaps has 20 months
    rate = found["rate"]
    assert rate.months == rate.default_n == 40 and rate.default_r == pytest.approx(np.corrcoef(x[:40], y)[0, 1], abs=1e-6)

    def auto(v):
        d = np.asarray(v) - np.mean(v)
        return d[:-1] @ d[1:] / (d @ d)

    rho = auto(x[:40]) * auto(y)
    assert rate.default_n_effective == pytest.approx(max(4, 40 * (1 - rho) / (1 + rho)), abs=1e-3)
    assert (rate.expected_sign, rate.default_sign, rate.default_sign_ok) == (-1, 1, False)
    both = pd.DataFrame({"x": np.repeat(x[:40], 2), "s": [s for _, s, _ in severity]}).rank()
    assert rate.severity_n == 80 and rate.severity_r == pytest.approx(both.corr().iloc[0, 1], abs=1e-9) and rate.severity_n_effective <= 40
    assert found["odd"].months == 39 and found["odd"].default_sign_ok
    flat = found["flat"]
    assert flat.months == 40 and all(flat[c] is None for c in ("default_r", "default_p", "default_sign", "default_sign_ok", "severity_r", "severity_sign", "expected_sign"))
    window = ml.estimation_window(target).first()
    assert tuple(window) == (dt.date(2001, 1, 1), MONTHS[39], 40)


def test_rank_correlation_of_millions_of_defaults(spark):
    months = MONTHS[:30]
    x = [math.sin(i) for i in range(30)]
    cells = lambda times: [(m, round(0.1 + 0.02 * ((7 * i + k) % 30), 2), times * (k + 1)) for i, m in enumerate(months) for k in range(3)]
    terms = spark.createDataFrame(series("rate", x), CANDIDATE)
    few, many = [rank_correlations(terms, spark.createDataFrame(cells(n), "month date, severity double, n long")).first() for n in (1, 100_000)]
    assert many.n == 18_000_000 and many.r == pytest.approx(few.r, abs=1e-6) and many.n_effective == few.n_effective
