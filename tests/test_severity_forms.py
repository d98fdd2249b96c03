"""Severity, shapes, forms and cores against plain computations on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import binning, estimate, forms, severity
from riskpanel.plans import search


def test_thin_bins_join_from_the_left():
    assert severity.merged([30, 30, 30]) == [0, 1, 2]
    assert severity.merged([10, 10, 10, 40]) == [0, 0, 0, 1]
    assert severity.merged([30, 10, 10]) == [0, 0, 0]
    assert severity.merged([40, 24, 2, 30]) == [0, 1, 1, 2]
    assert severity.merged([3]) == [0] and severity.merged([]) == []


def test_severity_bins_merge_thin_ones_and_keep_sums(spark):
    rng = np.random.default_rng(3)
    x, s = rng.normal(size=80), rng.uniform(0.05, 0.95, 80)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, s)], "x double, lgd_realised double")
    out = sorted(severity.bins(df, ["x"]).collect(), key=lambda r: r.bin)
    # Five bins of 16 rows: two by two, and the fifth joins the second pair.
    assert [r.n for r in out] == [32, 48]
    cut = np.quantile(x, 0.4)
    low, high = s[x < cut], s[x >= cut]
    assert out[1].lo == pytest.approx(cut) and out[0].lo is None
    assert [r.mean for r in out] == pytest.approx([low.mean(), high.mean()], abs=1e-7)
    assert [r.se for r in out] == pytest.approx([v.std(ddof=1) / math.sqrt(len(v)) for v in (low, high)], abs=1e-7)
    logit = lambda p: math.log(p / (1 - p))
    assert [r.weight for r in out] == pytest.approx([logit(v.mean()) - logit(s.mean()) for v in (low, high)], abs=1e-6)


def test_few_severities_are_refused_and_assumed_ones_are_flat(spark):
    df = spark.range(59).select(F.lit(1).alias("default_flag"), F.lit(0.4).alias("lgd_realised"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="59"):
        severity.fit(df, {"x": "scaled"})
    assert df.select(severity.assumed(0.3).score().alias("p")).agg(F.min("p"), F.max("p")).first() == pytest.approx((0.3, 0.3))
    for v in (0.0, 1.0):
        with pytest.raises(ValueError):
            severity.assumed(v)


def test_missing_driver_at_score_time_is_an_error(spark):
    model = estimate.Model(["(intercept)", "x"], [0.0, 1.0], [0.1] * 2, 0.0, 0, [estimate.Term("x", "scaled")])
    with pytest.raises(ValueError, match="needs x"):
        severity.scored(spark.range(3).withColumn("lgd_realised", F.lit(0.1)), model)


def logistic(x, y, rounds=60):
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    return b, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), p


def test_link_test_finds_a_bent_mean(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, 400)
    y = np.clip(1 / (1 + np.exp(-(x + 0.8 * x * x - 1))) + rng.normal(0, 0.02, 400), 0, 1)
    b, _, p = logistic(np.column_stack([np.ones(400), x]), y)
    rows = spark.createDataFrame([(float(a), float(c)) for a, c in zip(y, p)], "actual double, predicted double")
    coefficient, z, tail = severity.link_test(rows)
    eta = np.log(p / (1 - p))
    z3 = np.column_stack([np.ones(400), eta, eta**2])
    own, _, q = logistic(z3, y)
    bread = np.linalg.inv(z3.T @ (z3 * (q * (1 - q))[:, None]))
    cov = bread @ (z3.T @ (z3 * ((y - q) ** 2)[:, None])) @ bread
    assert coefficient == pytest.approx(own[2], abs=1e-5)
    assert z == pytest.approx(own[2] / math.sqrt(cov[2, 2]), rel=1e-4) and tail < 0.05


def test_backtest_needs_rows_on_both_sides(spark):
    df = spark.range(90).select(F.lit(1).alias("default_flag"), ((F.col("id") % 10) / 10).alias("lgd_realised"), (F.col("id") % 7).cast("double").alias("x"), F.expr("date_add(DATE'2000-01-01', CAST(id AS INT))").alias("performance_date"))
    assert severity.backtest(df, {"x": "scaled"}, "2000-03-20").count() == 0  # 79 and 11
    out = {r["slice"]: r for r in severity.backtest(df, {"x": "scaled"}, "2000-03-06").collect()}
    assert out["train"].n == 65 and out["test"].n == 25
    assert out["train"].mean_predicted == pytest.approx(out["train"].mean_actual, abs=1e-6)


def test_shapes_agree_with_polynomials(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, 6000)
    rate = {"line": 1 / (1 + np.exp(-(0.4 * x - 4))), "hump": 1 / (1 + np.exp(-(-0.25 * (x - 5) ** 2 + 0.5)))}
    for name, p in rate.items():
        y = (rng.uniform(size=6000) < p).astype(int)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
        r = forms.shapes(df, ["x"], "y").first()
        bins = sorted(binning.numeric_screen(df, ["x"], "y").filter("bin >= 0 AND n > 0").collect(), key=lambda b: b.bin)
        e = np.quantile(x, [i / 8 for i in range(1, 8)])
        at = np.array([e[0], *((e[1:] + e[:-1]) / 2), e[-1]])
        z, w, v = (at - at.mean()) / at.std(), np.array([b.n for b in bins], float), np.array([b.woe for b in bins])
        w = w / w.sum()

        def r2(d):
            own = np.vander(z, d + 1) * np.sqrt(w)[:, None]
            fit = np.vander(z, d + 1) @ np.linalg.lstsq(own, v * np.sqrt(w), rcond=None)[0]
            return 1 - (w * (v - fit) ** 2).sum() / (w * (v - np.average(v, weights=w)) ** 2).sum()

        assert r.linear_r2 == pytest.approx(r2(1), abs=1e-5) and r.smooth_r2 == pytest.approx(max(r2(2), r2(3)), abs=1e-5)
        assert r.curvature == pytest.approx(r2(2) - r2(1), abs=1e-5)
        assert r.treatment == {"line": "continuous", "hump": "spline"}[name]


def test_shape_of_a_constant_and_of_few_values(spark):
    df = spark.createDataFrame([(1.0, i % 2, float(i % 3)) for i in range(60)], "flat double, y int, few double")
    out = {r.column_name: r for r in forms.shapes(df, ["flat", "few"], "y").collect()}
    assert out["flat"].treatment == out["few"].treatment == "woe" and out["flat"].confidence == "low" and out["flat"].linear_r2 is None


def test_forms_by_information_on_events(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 3000)
    for bend, want in ((0.0, "continuous"), (1.5, "spline")):
        y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(0.2 * x - 3 + bend * np.maximum(x - 6, 0))))).astype(int)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
        f = forms.compared(df, "x", "y", [6.0, 99.0])
        z = (x - x.mean()) / x.std()
        straight = logistic(np.column_stack([np.ones(3000), z]), y)[1]
        bent = logistic(np.column_stack([np.ones(3000), z, np.maximum(x - 6, 0)]), y)[1]
        assert f["straight"]["log_likelihood"] == pytest.approx(straight, abs=1e-5)
        assert f["bent"]["delta_bic"] == pytest.approx(2 * (straight - bent) + math.log(y.sum()), abs=1e-4)
        assert forms.recommended(f, 0) == want and forms.recommended(f, 2) == ("bins" if want == "spline" else want)
    assert forms.compared(df, "x", "y", [99.0])["bent"] is None


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    a, b, noise = rng.normal(size=(3, 2500))
    y = (rng.uniform(size=2500) < 1 / (1 + np.exp(-(1.2 * a + 0.6 * b - 1.5)))).astype(int)
    rows = [(float(u), float(u + 0.05 * n), float(v), float(n), 1.0, int(t)) for u, v, n, t in zip(a, b, noise, y)]
    return spark.createDataFrame(rows, "a double, copy double, b double, dpd_noise double, one double, y int")


def test_cores_leave_out_copies_noise_and_constants(panel):
    found = search.cores(panel, "y", dict.fromkeys(["a", "b", "dpd_noise", "one"], "scaled"), search.Rules(strong=1), expert=["dpd_noise"])
    steps = {n: [(x, c) for x, c, _ in t] for n, t in found.items()}
    assert steps["stepwise"] == [("unfit", "one"), ("enter", "a"), ("enter", "b")]
    assert steps["strong"] == [("keep", "a")] and steps["expert"] == [("expert", "dpd_noise"), ("cyclical", "dpd_noise")]
    # A cap that nothing but a single term meets keeps all others out, by name.
    capped = search.cores(panel, "y", dict.fromkeys(["a", "b"], "scaled"), search.Rules(metric="p_value", inflation=1.0))["stepwise"]
    assert [(x, c) for x, c, _ in capped] == [("enter", "a"), ("blocked", "b")]
    with pytest.raises(ValueError):
        search.Rules(metric="r2")


def test_inflation_of_a_copy_is_found(panel):
    trials = search.Trials(panel, "y", dict.fromkeys(["a", "copy", "b"], "scaled"))
    r = np.corrcoef(np.array([[x.a, x.copy, x.b] for x in panel.collect()]).T)
    assert trials.inflation(["a", "copy"]) == pytest.approx(np.linalg.inv(r[:2, :2])[0, 0], rel=1e-3) and trials.inflation(["b"]) == 1.0
    trials.close()


def test_macro_screen_by_sign_and_tail(panel):
    out = {r.term: r for r in search.macro_screen(panel, "y", {"a": "scaled"}, {"b": -1, "dpd_noise": None, "one": 1}).collect()}
    assert out["b"].reason == "sign" and out["b"].beta > 0 and out["one"].reason == "one value"
    assert out["dpd_noise"].reason == "p" and not out["dpd_noise"].kept
    assert search.macro_screen(panel, "y", {"a": "scaled"}, {"b": 1}).first().kept
