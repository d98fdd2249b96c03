"""Design treatments and their alignment, and the record of a fit, against plain computations."""

import math

import numpy as np
import pytest

from riskpanel.operators import estimate, fit_record


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(8)
    n = 3000
    a, b = r.normal(size=(2, n))
    c = 0.7 * a + 0.4 * b + 0.5 * r.normal(size=n)
    vintage = r.integers(2001, 2006, n)
    level = r.choice(["x", "y", "z"], n)
    p = 1 / (1 + np.exp(-(-2 + 0.8 * a - 0.5 * b + 0.3 * (vintage == 2003))))
    return a, b, c, vintage, level, (r.random(n) < p).astype(int)


@pytest.fixture(scope="module")
def frame(spark, data):
    a, b, c, v, level, y = data
    rows = [(float(i), float(j), float(k), float(i) + float(j), int(w), str(m), 7.0, int(t)) for i, j, k, w, m, t in zip(a, b, c, v, level, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, both double, vintage int, level string, one double, y int").persist()


def irls(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)))


def test_record_of_a_sound_fit(frame, data):
    a, b, c, v, _, y = data
    model, rec = fit_record.fit_recorded(frame, "y", {"a": "scaled", "c": "scaled", "vintage": "vintage", "one": "scaled"})
    assert model.names == ["(intercept)", "a", "c", "vintage_2002", "vintage_2003", "vintage_2004", "vintage_2005"] and model.dropped == rec.dropped == ["one"]
    z = lambda v: (v - v.mean()) / v.std()
    x = np.column_stack([np.ones(len(y)), z(a), z(c), *[v == k for k in range(2002, 2006)]]).astype(float)
    beta, se = irls(x, y)
    assert np.allclose(model.beta, beta, atol=1e-6) and np.allclose(model.se, se, rtol=1e-5)
    by = {t.name: t for t in rec.lines}
    r = np.corrcoef(x[:, 1:], rowvar=False)
    assert np.allclose([t.vif for t in rec.lines[1:]], np.diag(np.linalg.inv(r)), rtol=1e-6)
    share = beta[1:] ** 2 * x[:, 1:].var(axis=0)
    assert np.allclose([t.contribution for t in rec.lines[1:]], share / share.sum(), rtol=1e-5)
    det = np.linalg.det
    want = (det(r[2:, 2:]) * det(r[:2, :2]) / det(r)) ** (1 / 4)
    assert by["vintage_2004"].term == "vintage" and by["vintage_2004"].term_columns == 4 and by["vintage_2004"].term_vif == pytest.approx(want, rel=1e-6)
    assert rec.warning == "" and rec.events == y.sum() and not rec.aliased


def test_columns_that_are_there_twice(frame):
    _, rec = fit_record.fit_recorded(frame, "y", {"a": "scaled", "b": "scaled", "both": "scaled", "level": "dummy_levels"})
    assert len(rec.aliased) == 1
    name, own = next(iter(rec.aliased.items()))
    assert {name, *own} == {"a", "b", "both"} and rec.warning.startswith("rank deficient") and name in rec.warning
    by = {t.name: t for t in rec.lines}
    assert all(math.isinf(by[c].vif) and math.isinf(by[c].term_vif) for c in ("a", "b", "both"))
    assert by["level=y"].vif < 2 and by["level=y"].term == "level"


def test_dependencies_of_matrices():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 6))
    x[:, 4] = x[:, 1] - 2 * x[:, 3]
    x[:, 5] = 3 * x[:, 0] + 1
    found = fit_record.dependencies(fit_record.correlations_of(np.cov(x, rowvar=False)))
    sets = sorted(sorted([i, *own]) for i, own in found.items())
    assert sets == [[0, 5], [1, 3, 4]]
    assert fit_record.dependencies(np.eye(3)) == {} and fit_record.dependencies(np.zeros((0, 0))) == {}


def test_separation_and_few_events(spark, frame):
    rows = [(float(i), int(i >= 500)) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, y int")
    model, rec = fit_record.fit_recorded(df, "y", {"x": "scaled"})
    assert rec.warning.startswith("separated: x")
    with pytest.raises(ValueError, match="49 events"):
        fit_record.fit_recorded(df.filter("x < 549"), "y", {"x": "scaled"})


def test_scoring_rows_take_the_fitted_cells(spark, frame):
    train = frame.filter("vintage <= 2003 AND level != 'z'")
    model = estimate.fit_logistic(train, "y", {"vintage": "vintage", "level": "dummy_levels", "one": "scaled"})
    assert model.names == ["(intercept)", "vintage_2002", "vintage_2003", "level=y"]
    at = lambda v, k: spark.createDataFrame([(v, k, 1.0)], "vintage int, level string, one double").select(model.score()).first()[0]
    # Levels that the fit never saw, and nulls, score as the reference.
    assert at(2005, "z") == at(2001, "x") == at(None, None) and at(2003, "x") != at(2001, "x")
    again = estimate.Model.from_json(model.to_json())
    assert again == model and again.dropped == ["one"]


def test_ordinal_bins_and_flags(spark):
    df = spark.createDataFrame([(None,), (1.0,), (5.0,), (9.0,)], "x double")
    show = lambda t: [tuple(r) for r in estimate.design(df, [t])[0].collect()]
    assert show(estimate.Term("x", "ordinal", edges=[2.0, 6.0])) == [(1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 2.0)]
    t = estimate.Term("x", "dummies", edges=[2.0])
    assert [n for n, _ in t.columns()] == ["x_flag"] and [r[1] for r in show(t)] == [0.0, 0.0, 1.0, 1.0]
    t = estimate.Term("x", "dummies", edges=[2.0, 6.0], missing=1.0)
    assert [n for n, _ in t.columns()] == ["x=1", "x=2", "x=Missing"] and show(t)[0] == (1.0, 0.0, 0.0, 1.0)
    fitted = estimate.fit_terms(spark.createDataFrame([(float(i), i % 2) for i in range(50)], "x double, y int"), "y", {"x": "ordinal"})[0]
    assert fitted.treatment == "ordinal" and len(fitted.edges) == 4


def test_terms_are_bound_to_their_rows(frame):
    early = estimate.fit_logistic(frame.filter("vintage < 2003"), "y", {"a": "woe"})
    with pytest.raises(ValueError, match="other rows: a"):
        estimate.fit_logistic(frame, "y", {}, terms=early.terms)
    again = estimate.fit_logistic(frame.filter("vintage < 2003").repartition(5), "y", {}, terms=early.terms)
    assert np.allclose(again.beta, early.beta, atol=1e-9) and again.slice == early.slice


def test_penalties(frame, data):
    a, _, _, _, _, y = data
    z = (a - a.mean()) / a.std()
    x = np.column_stack([np.ones(len(y)), z])
    l2, beta = estimate.ridge(30.0, len(y)), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0, l2]), x.T @ (y - p) - [0, l2 * beta[1]])
    assert np.allclose(estimate.fit_logistic(frame, "y", {"a": "scaled"}, l2=l2).beta, beta, atol=1e-6)
    term = [estimate.Term("a", "scaled", mean=float(a.mean()), sd=float(a.std()))]
    strong = estimate.fit_l1(frame, "y", term, 0.001)
    weak = estimate.fit_l1(frame, "y", term, 100.0)
    assert strong["a"] == 0.0 and weak["a"] == pytest.approx(irls(x, y)[0][1], abs=0.01)


def test_corrected_intercept(frame):
    model = estimate.Model(["(intercept)", "a"], [-1.0, 0.5], [0.1, 0.1], 0.0, 0, [])
    assert estimate.prior_correction(model, 0.25).beta == [-1.0 + math.log(0.25), 0.5] and model.beta[0] == -1.0
