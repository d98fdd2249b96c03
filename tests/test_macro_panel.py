"""Benchmarking with indicators and the macro panel by catalogue against plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from riskpanel.operators import benchmarking as bm
from riskpanel.operators import macro_catalogue as mc

QUARTERS = pd.date_range("2001-01-01", periods=9, freq="QS")
MONTHS = pd.date_range("2001-01-01", periods=27, freq="MS")


def plain(totals, rule, z, offset=0):
    """The same by the null space of the constraints."""
    m, n = len(totals), len(z)
    w = {"avg": [1 / 3] * 3, "sum": [1] * 3, "eop": [0, 0, 1]}[rule]
    c = np.zeros((m, n))
    for q in range(m):
        c[q, offset + 3 * q : offset + 3 * q + 3] = w
    a = c * z
    d = np.diff(np.eye(n), axis=0)
    u0 = np.linalg.lstsq(a, totals, rcond=None)[0]
    null = np.linalg.svd(a)[2][np.linalg.matrix_rank(a) :].T
    return (u0 - null @ np.linalg.lstsq(d @ null, d @ u0, rcond=None)[0]) * z


@pytest.mark.parametrize("rule", ["avg", "sum", "eop"])
@pytest.mark.parametrize("scale", [1e-3, 1.0, 3e4])
def test_proportional_benchmarking(rule, scale):
    r = np.random.default_rng(1)
    totals, z = scale * np.exp(r.normal(0, 0.3, 9)), np.exp(np.cumsum(r.normal(0, 0.1, 32)))
    for offset, months in ((0, 27), (2, 32)):
        x = bm.proportional(totals, rule, z[:months], offset, months)
        assert np.allclose(x, plain(totals, rule, z[:months], offset), rtol=1e-6)
        own = x[offset : offset + 27].reshape(9, 3)
        again = {"avg": own.mean(axis=1), "sum": own.sum(axis=1), "eop": own[:, 2]}[rule]
        assert np.abs(again / totals - 1).max() < 1e-10
    with pytest.raises(ValueError):
        bm.proportional(totals, rule, z[:20])


def series(spark, rows, name="period"):
    return spark.createDataFrame([(k, d.date(), float(v)) for k, d, v in rows], f"key string, {name} date, value double")


def test_both_ways_agree_at_the_end_of_quarters(spark):
    r = np.random.default_rng(2)
    v, z = 100 + np.cumsum(r.normal(0, 3, 9)), np.exp(np.cumsum(r.normal(0, 0.1, 27)))
    z[7] = np.nan
    quarterly = series(spark, [("a", q, x) for q, x in zip(QUARTERS, v, strict=True)] + [("b", q, x) for q, x in zip(QUARTERS[:3], v, strict=False)])
    indicator = series(spark, [("a", m, x) for m, x in zip(MONTHS, z, strict=True) if x == x], "month")
    got = bm.end_of_quarter(quarterly, indicator).toPandas().sort_values(["key", "month"])
    filled = pd.Series(z).interpolate().to_numpy()
    assert np.allclose(got[got["key"] == "a"]["value"], plain(v, "eop", filled), rtol=1e-8)
    assert np.allclose(got[got["key"] == "b"]["value"], plain(v[:3], "eop", np.ones(9)), rtol=1e-8)
    from pyspark.sql import functions as F

    solved = bm.benchmarked(quarterly.withColumn("agg", F.lit("eop")), indicator).toPandas().sort_values(["key", "month"])
    assert np.allclose(solved["value"], got["value"], rtol=1e-8)


def test_growth_goes_by_its_level(spark):
    g = [2.0, -1.0, 4.0, 0.5]
    out = bm.growth_by_level(series(spark, [("g", q, x) for q, x in zip(QUARTERS, g, strict=False)])).toPandas().sort_values("month")
    level = 100 * np.cumprod((1 + np.array(g) / 100) ** 0.25)
    assert np.allclose(out["level"].to_numpy()[2::3], level)
    months = np.concatenate([[100.0], out["level"]])
    assert np.allclose(out["value"], 100 * ((months[1:] / months[:-1]) ** 12 - 1))
    # The three months of a quarter make its growth: by their product, not by their mean.
    assert np.allclose(np.prod((1 + out["value"].to_numpy()[3:6] / 100) ** (1 / 12)), (1 + g[1] / 100) ** 0.25)


ENTRIES = [
    mc.Entry("day", "d", "D", "flow", "level", "sum"),
    mc.Entry("peak", "p", "D", "flow", "level", "max"),
    mc.Entry("last", "l", "W", "stock", "rate", "eop"),
    mc.Entry("plain", "m", "M", "stock", "index", "avg"),
    mc.Entry("gdp", "q", "Q", "flow", "growth", "avg", derive=True, indicator="plain"),
    mc.Entry("gone", "x", "M", "stock", "rate", "avg"),
]


def test_panel_of_mixed_frequencies(spark):
    days = [dt.date(2001, 1, 1) + dt.timedelta(i) for i in range(810)]
    monthly = [(m.date(), 50.0 + i + 5 * (i % 3)) for i, m in enumerate(MONTHS)]
    rows = [(k, d, float(i)) for i, d in enumerate(days) for k in ("day", "peak")] + [("last", d, float(i)) for i, d in enumerate(days[::7])] + [("plain", d, v) for d, v in monthly]
    rows += [("gdp", q.date(), 300.0 + 4 * i * i) for i, q in enumerate(QUARTERS)] + [("unknown", days[0], 1.0), ("day", days[3], None)]
    history = spark.createDataFrame(rows, "key string, date date, value double")
    catalogue = mc.table_of(spark, ENTRIES)
    got = {(r.key, r.month): r.value for r in mc.panel(history, catalogue).collect()}
    feb = [i for i, d in enumerate(days) if (d.year, d.month) == (2001, 2)]
    key = dt.date(2001, 2, 1)
    assert got["day", key] == sum(feb) and got["peak", key] == max(feb) and got["last", key] == max(i for i, d in enumerate(days[::7]) if d.month == 2 and d.year == 2001)
    level = plain(np.array([300.0 + 4 * i * i for i in range(9)]), "avg", np.array([v for _, v in monthly]))
    assert np.allclose([got["gdp_level", m.date()] for m in MONTHS], level, rtol=1e-8)
    assert got["gdp", MONTHS[5].date()] == pytest.approx(100 * ((level[5] / level[2]) ** 4 - 1)) and ("gdp", MONTHS[2].date()) not in got
    assert {k for k, _ in got} == {"day", "peak", "last", "plain", "gdp", "gdp_level"}
    status = {r.key: (r.status, r.n) for r in mc.resolved(catalogue, history).collect()}
    assert status["gone"] == ("missing", 0) and status["day"] == ("ok", 810)


def test_catalogue_refuses_what_it_does_not_know(spark):
    with pytest.raises(ValueError):
        mc.Entry("a", "a", "Y", "stock", "rate", "avg")
    with pytest.raises(ValueError):
        mc.Entry("a", "a", "Q", "stock", "rate", "max")
    with pytest.raises(ValueError):
        mc.table_of(spark, [ENTRIES[0], ENTRIES[0]])
