"""Severity search, spline bases and knots, reviews and versions, against plain computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import estimate, forms, knots, quality
from riskpanel.plans import reviews, search, severity_search, specs


def fractional(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    return b, np.sqrt(np.diag(inverse @ ((x * ((y - p) ** 2)[:, None]).T @ x) @ inverse)), p


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    a, b, noise, m = rng.normal(size=(4, 900))
    y = np.clip(1 / (1 + np.exp(-(0.8 * a + 0.3 * b + 0.4 * m - 0.4))) + rng.normal(scale=0.1, size=900), 0, 1)
    return a, a + 0.05 * noise, b, noise, m, y


@pytest.fixture(scope="module")
def seen(spark, data):
    rows = [(f"20{10 + i % 10}-06-01", *map(float, r), 1.0) for i, r in enumerate(zip(*data))]
    df = spark.createDataFrame(rows, "d string, a double, copy double, b double, noise double, `rate@level@0` double, lgd_realised double, one double")
    return df.withColumn("performance_date", F.to_date("d")).drop("d")


def test_robust_tests_and_cores(seen, data):
    a, _, b, _, _, y = data
    trials = severity_search.SeverityTrials(seen.withColumnRenamed("rate@level@0", "m"), "lgd_realised", ["a", "copy", "b", "noise", "one"])
    z = lambda v: (v - v.mean()) / v.std()
    beta, se, _ = fractional(np.column_stack([np.ones(900), z(a), z(b)]), y)
    got = trials.tested(["b", "a"])
    for i, c in enumerate(["", "a", "b"]):
        assert got[c][:2] == pytest.approx((beta[i], se[i]), rel=1e-4)
    assert trials.correlation("a", "copy") == pytest.approx(abs(np.corrcoef(a, data[1])[0, 1]), abs=1e-6)
    found = severity_search.cores_of(trials, ["a", "copy", "b", "noise", "one"], search.Rules(strong=1), expert=["noise"])
    steps = [(x, c) for x, c, _ in found["stepwise"]]
    assert steps[0] == ("unfit", "one") and steps[1][1] in ("a", "copy") and steps[2] == ("enter", "b")
    assert len(severity_search.columns_of(found["stepwise"])) == 2 and severity_search.columns_of(found["strong"]) == [steps[1][1]]
    assert severity_search.columns_of(found["expert"]) == ["noise"]
    out = {c: x for x, c in steps if x in ("blocked", "rejected")}
    assert out["noise"] == "rejected" and set(out) == {"noise", {"a": "copy", "copy": "a"}[steps[1][1]]}
    keep = found["strong"][0]
    assert keep[2] == pytest.approx(2 * (trials.fitted(["b", keep[1]])[0] - trials.fitted(["b"])[0]))
    trials.close()


def test_fits_before_and_after(seen, data):
    a, _, b, _, m, y = data
    out = {tuple(r.columns): r for r in severity_search.fits(seen, "lgd_realised", {"x": ["a", "b"], "again": ["b", "a"]}, ["rate@level@0", "one"], "2018-01-01", search.Rules(inflation=5.0)).collect()}
    assert set(out) == {("a", "b"), ("a", "b", "rate@level@0")}
    late = np.arange(900) % 10 >= 8
    z = lambda v: (v - v[~late].mean()) / v[~late].std()
    x = np.column_stack([np.ones(900), z(a), z(b), z(m)])
    beta, _, _ = fractional(x[~late], y[~late])
    gap = np.abs(y - 1 / (1 + np.exp(-x @ beta)))
    r = out["a", "b", "rate@level@0"]
    assert (r.n_train, r.n_test, r.filtered) == (720, 180, None)
    assert r.mae_in == pytest.approx(gap[~late].mean(), abs=1e-5) and r.mae_oot == pytest.approx(gap[late].mean(), abs=1e-5)
    few = severity_search.fits(seen.filter("performance_date < '2018-01-01' OR noise > 2"), "lgd_realised", {"x": ["a"]}, [], "2018-01-01").first()
    assert few.n_test < 20 and few.mae_oot is None


def test_spline_spans_the_hinges_and_is_uncorrelated(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(2, 10, 500)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    term = estimate.spline_term(df, "x", [1.0, 4.0, 7.0, 11.0], 5.0)
    assert term.edges == [4.0, 7.0]
    found = np.array(df.filter("x IS NOT NULL").select(*[c.alias(f"z{i}") for i, (_, c) in enumerate(term.columns())]).collect())
    v = np.append(x, 5.0)
    raw = np.column_stack([v, np.maximum(v - 4, 0), np.maximum(v - 7, 0)])
    own = np.array(df.select(*[c.alias(f"z{i}") for i, (_, c) in enumerate(term.columns())]).collect())
    assert np.allclose(own.T @ own / 501, np.eye(3), atol=1e-8) and np.allclose(own.mean(axis=0), 0, atol=1e-9)
    fit = np.linalg.lstsq(own, raw - raw.mean(axis=0), rcond=None)[0]
    assert np.allclose(own @ fit, raw - raw.mean(axis=0), atol=1e-8) and len(found) == 500
    flat = estimate.spline_term(spark.createDataFrame([(1.0,)] * 3, "x double"), "x", [1.0], 1.0)
    assert not flat.edges and len(flat.columns()) == 1
    again = estimate.Term(**json.loads(estimate.Model([], [], [], 0.0, 0, [term]).to_json())["terms"][0])
    assert again == term


def test_spline_in_a_fit_equals_hinges(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 1500)
    y = (rng.uniform(size=1500) < 1 / (1 + np.exp(-(0.5 * np.maximum(x - 5, 0) - 1)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    a, b = (estimate.fit_logistic(df, "y", {"x": how}) for how in ("spline", "hinges"))
    assert a.log_likelihood == pytest.approx(b.log_likelihood, abs=1e-6) and len(a.beta) == len(b.beta)


def test_severity_knot_where_the_slope_turns(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, 4000)
    s = 1 / (1 + np.exp(-(1.2 * np.maximum(x - 6, 0) - 2)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, s)], "x double, s double")
    found = knots.search(df, "x", "s", 1, 40, severity=True)
    assert len(found.knots) == 1 and abs(found.knots[0] - 6) < 0.6 and found.gain_over_line > 0 and found.gain_over_even >= 0
    assert knots.search(df.limit(50), "x", "s", severity=True).note == "too few events"


def test_reviews_need_reasons(spark, tmp_path):
    r = reviews.Reviews(spark, str(tmp_path / "audit"))
    assert r.state().count() == 0
    r.update("m1", {"status": "challenger"}, "ann")
    r.update("m1", {"status": "challenger"}, "ann")
    with pytest.raises(reviews.ReviewError):
        r.update("m1", {"status": "rejected"}, "ann")
    with pytest.raises(reviews.ReviewError):
        r.update("m1", {"status": "challenger"}, " ")
    with pytest.raises(reviews.ReviewError):
        r.update("m1", {"user_rank": 2}, "ann", auto_rank=1)
    with pytest.raises(reviews.ReviewError):
        r.update("m1", {"reason_code": "mood"}, "ann")
    r.update("m1", {"status": "rejected", "justification": "unstable"}, "bo")
    with pytest.raises(reviews.ReviewError):
        r.reorder(["m2", "m1", "m3"], "ann", {"m1": 1, "m2": 2, "m3": 3})
    r.reorder(["m2", "m1", "m3"], "ann", {"m1": 1, "m2": 2, "m3": 3}, {"m2": "simpler"})
    state = {x.model: x for x in r.state().collect()}
    assert state["m1"].status == "rejected" and (state["m1"].user_rank, state["m2"].user_rank) == (2, 1) and "m3" not in state
    assert [(x.field, x.before, x.after) for x in r.audit().filter("model = 'm1'").orderBy("seq").collect()] == [("status", None, "challenger"), ("status", "challenger", "rejected"), ("justification", None, "unstable"), ("user_rank", None, "2")]
    r.export_csv(str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == r.audit().count()


def test_versions_over_their_life(spark, tmp_path):
    v = specs.Versions(spark, str(tmp_path / "versions"))
    a, b = v.save({"variables": [], "book": "x"}, {"auc": 0.7}), v.save({"variables": [], "book": "y"}, {"auc": 0.8, "ks": 0.3})
    v.promote(a)
    v.promote(b)
    assert v.champion() == b and {r.hash: r.state for r in v.table().collect()} == {a: "archived", b: "champion"}
    assert [(r.metric, r.change) for r in v.compare(a, b).collect()] == [("auc", pytest.approx(0.1)), ("ks", None)]
    text = v.export(b)
    v.delete(b)
    assert v.champion() is None
    with pytest.raises(KeyError):
        v.load(b)
    with pytest.raises(ValueError):
        v.take(text, lambda spec: {"auc": 0.8, "ks": 0.3001})
    with pytest.raises(ValueError):
        v.take(json.dumps({**json.loads(text), "hash": "0"}), lambda spec: {})
    assert v.take(text, lambda spec: {"auc": 0.8, "ks": 0.3}) == b and v.load(b)["metrics"]["ks"] == 0.3


def test_digest_tells_changes(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b")], "k int, v double, t string")
    one = quality.content_digest(df).first().digest
    assert len(one) == 12 and one == quality.content_digest(df.select("v", "k")).first().digest
    assert one != quality.content_digest(df.withColumn("v", F.col("v") * 1.001)).first().digest
    assert one == quality.content_digest(df.withColumn("v", F.col("v") * (1 + 1e-9))).first().digest


def test_knots_of_an_event(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(50, 20, 8000)
    p = 1 / (1 + np.exp(-(-3 + 0.12 * np.maximum(x - 60, 0) - 0.1 * np.maximum(x - 85, 0))))
    y = (rng.random(8000) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "x double, y int")
    found = knots.search(df, "x", "y", 2)
    lo, hi = np.quantile(x, [0.01, 0.99])
    candidates = np.quantile(np.clip(x, lo, hi), knots.GRID)
    assert all(min(abs(k - candidates)) < 1e-9 for k in found.knots) and len(found.knots) == 2
    assert found.knots[1] - found.knots[0] > knots.SEPARATION * (hi - lo) and abs(found.knots[0] - 60) < 8
    assert found.gain_over_even >= 0
    # Of all pairs none is better by much: the search is greedy, but it refines.
    edges = np.unique(np.quantile(np.clip(x, lo, hi), np.linspace(0, 1, 121)))
    at = np.clip(np.digitize(np.clip(x, lo, hi), edges[1:-1]), 0, len(edges) - 2)
    n, e = np.bincount(at).astype(float), np.bincount(at, weights=y)
    assert found.buckets == len(n)
    mid = (edges[:-1] + edges[1:]) / 2
    line = knots.likelihood(mid, n, e, [])
    best = max(knots.likelihood(mid, n, e, [a, b]) for i, a in enumerate(candidates) for b in candidates[i + 1 :] if b - a > knots.SEPARATION * (hi - lo))
    assert found.gain_over_line == pytest.approx(knots.likelihood(mid, n, e, found.knots) - line, abs=1e-6) and best - line - found.gain_over_line < 0.1 * (best - line)
    assert knots.search(df.limit(400), "x", "y").note and knots.search(df.withColumn("x", F.lit(1.0)), "x", "y").note == "no range"
    assert knots.search(df.withColumn("x", F.round(F.col("x") / 60)), "x", "y").note == "too few values"


def test_severity_forms(spark):
    rng = np.random.default_rng(8)
    v = rng.uniform(0, 10, 1200)
    s = np.clip(1 / (1 + np.exp(-(0.9 * np.maximum(v - 6, 0) - 1))) + rng.normal(0, 0.2, 1200), 0, 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, s)] + [(None, 0.5), (1.0, None)], "x double, s double")
    got = forms.severity_forms(df, "x", "s", [6.0, 99.0])
    z = (v - df.filter("s IS NOT NULL").toPandas()["x"].mean()) / df.filter("s IS NOT NULL").toPandas()["x"].std(ddof=0)
    d = np.column_stack([np.ones(1200), z, np.maximum(v - 6, 0)])
    beta, se, p = fractional(d, s)
    bent = got["bent"]
    assert bent["knots"] == [6.0] and bent["wald"] == pytest.approx((beta[2] / se[2]) ** 2, rel=1e-3) and bent["wald_p"] < 1e-6
    phi = ((s - p) ** 2 / (p * (1 - p))).sum() / (1200 - 3)
    assert bent["dispersion"] == pytest.approx(phi, rel=1e-6)
    ll = (s * np.log(p) + (1 - s) * np.log(1 - p)).sum()
    assert bent["bic"] == pytest.approx(-2 * ll / phi + 3 * np.log(1200), rel=1e-6) and bent["delta_bic"] < 0
    assert forms.severity_forms(df, "x", "s", [])["bent"] is None
