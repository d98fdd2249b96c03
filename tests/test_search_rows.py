"""Joint fits of cores and macro terms, the tree of correlations, and rising stress, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import binning, estimate, evaluate
from riskpanel.plans import search, severity_search


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(12)
    n = 4000
    month = r.integers(0, 40, n)
    path = np.cumsum(r.normal(0, 1, 40))
    a, b = r.normal(size=(2, n))
    p = 1 / (1 + np.exp(-(-1.5 + 0.8 * a + 0.25 * path[month])))
    return a, b, path[month], r.normal(size=40)[month], month, (r.random(n) < p).astype(int)


@pytest.fixture(scope="module")
def panel(spark, data):
    rows = [(f"20{10 + int(m) // 12}-{int(m) % 12 + 1:02d}-01", float(i), float(j), float(x), float(z), int(t)) for i, j, x, z, m, t in zip(*data, strict=True)]
    df = spark.createDataFrame(rows, "d string, a double, b double, `rate@level@0` double, `gdp@level@0` double, y int")
    return df.withColumn("performance_date", F.to_date("d")).drop("d").persist()


def logit_fit(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def auc(p, y):
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    e = y.sum()
    return (rank[y == 1].sum() - e * (e + 1) / 2) / (e * (len(y) - e))


def test_rows_of_all_combinations(panel, data):
    a, b, rate, _, month, y = data
    out = search.joint_rows(panel, "y", "2012-07-01", {"x": ["a", "b"], "again": ["b", "a"]}, {"a": "scaled", "b": "scaled"}, [("rate@level@0",), ("rate@level@0", "gdp@level@0")], {"rate@level@0": -1, "gdp@level@0": None}, search.Rules(frame=None))
    found = {tuple(r.terms): r for r in out.collect()}
    assert set(found) == {(), ("rate@level@0",), ("rate@level@0", "gdp@level@0")}
    early = month < 30
    z = lambda v: (v - v[early].mean()) / v[early].std()
    x = np.column_stack([np.ones(len(y)), z(a), z(b), z(rate)])
    beta, se = logit_fit(x[early], y[early])
    r = found[("rate@level@0",)]
    p = 1 / (1 + np.exp(-x @ beta))
    assert r.auc_in == pytest.approx(auc(p[early], y[early]), abs=1e-6) and r.auc_oot == pytest.approx(auc(p[~early], y[~early]), abs=1e-6)
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p))[early].sum()
    assert (r.n, r.events) == (early.sum(), y[early].sum()) and r.log_likelihood == pytest.approx(ll, abs=1e-3)
    from riskpanel.functions.special import normal_tail

    assert r.max_p == pytest.approx(max(normal_tail(t) for t in (beta / se)[1:]), abs=1e-4)
    assert r.wrong_signs == ["rate@level@0"] and r.filtered == "sign" and r.max_inflation < 1.1
    assert found[()].terms == [] and found[()].wrong_signs == []


def test_many_fits_equal_single_ones(panel):
    rows, _ = estimate.design(panel, [estimate.Term("a", "scaled"), estimate.Term("b", "scaled"), estimate.Term("rate@level@0", "scaled")], F.col("y").cast("double").alias("y"))
    rows = rows.persist()
    trials = {"a": [0, 1], "b": [0, 2], "all": [0, 1, 2, 3], "none": [0]}
    many = estimate.newton_many(rows, trials, rate=0.3)
    for name, cells in trials.items():
        own = rows.select("y", *[F.col(f"x{c}").alias(f"x{i}") for i, c in enumerate(cells)])
        h, g, ll, n, meat = estimate.sums(own, many[name][0], meat=True)
        assert np.abs(g).max() < 1e-6 and np.allclose(h, many[name][1], rtol=1e-9) and ll == pytest.approx(many[name][2]) and n == many[name][3] == 4000
        assert np.allclose(estimate.meats(rows, {name: (cells, many[name][0])})[name], meat, rtol=1e-8)
    rows.unpersist()


def test_frames_bound_the_trials(panel):
    trials = search.Trials(panel, "y", {"a": "scaled"}, 2500)
    assert trials.n == 2500 and trials.events == panel.filter("y = 1").count()
    trials.close()


def test_tree_and_order_of_leaves():
    d = np.array([[0, 2, 6, 10, 9], [2, 0, 5, 9, 8], [6, 5, 0, 4, 5], [10, 9, 4, 0, 3], [9, 8, 5, 3, 0.0]]) / 20
    tree = binning.linkage(1 - d)
    assert [(a, b, round(20 * x, 6), n) for a, b, x, n in tree] == [(0, 1, 2.0, 2), (3, 4, 3.0, 2), (2, 6, 4.5, 3), (5, 7, round((6 + 10 + 9 + 5 + 9 + 8) / 6, 6), 5)]
    assert binning.leaf_order(tree, 5) == [0, 1, 2, 3, 4]
    m = np.array([[1, 0.1, 0.9], [0.1, 1, 0.2], [0.9, 0.2, 1]])
    assert binning.leaf_order(binning.linkage(m), 3) == [1, 0, 2] and binning.clusters(m) == [0, 1, 0]
    assert binning.leaf_order(binning.linkage(np.eye(1)), 1) == [0] and binning.clusters(np.zeros((0, 0))) == []


def test_report_of_correlations(panel):
    df = panel.withColumns({"twin": 2 * F.col("a") + 0.01 * F.col("b"), "flat": F.lit(1.0)})
    for method in ("pearson", "spearman"):
        rows = binning.correlation_report(df, ["a", "b", "flat", "twin"], method).collect()
        by = {(r.a, r.b): r for r in rows}
        assert set(by) == {("a", "b"), ("a", "twin"), ("b", "twin")} and by["a", "twin"].high and not by["a", "b"].high
        assert abs(by["a", "twin"].place_a - by["a", "twin"].place_b) == 1 and by["a", "twin"].cluster is not None and by["a", "b"].cluster is None
    assert len(binning.correlation_report(df, ["a", "b", "twin"], most=2).collect()) == 1


def test_rising_stress():
    rows = [{"scenario": s, "t": v} for s, own in {"mild": [1.0, 1.5, 1.2], "severe": [1.0, 3.0, 2.0]}.items() for v in own]
    assert severity_search.rises({"t": 0.4}, rows, ["mild", "severe"])
    assert not severity_search.rises({"t": -0.4}, rows, ["mild", "severe"]) and not severity_search.rises({"t": 0.4}, rows, ["severe", "mild"])


def test_coverage_of_intervals(spark):
    table = spark.createDataFrame([("2000-01-01", 1000, 20, 0.02), ("2000-04-01", 1000, 20, 0.08), ("2001-01-01", 500, 0, 0.0001)], "d string, n long, events long, predicted double").withColumn("period", F.to_date("d")).select("period", "n", "events", "predicted")
    got = {r["slice"]: (r.periods, r.covered) for r in evaluate.coverage(evaluate.with_intervals(table), "2001-01-01").collect()}
    assert got == {"all": (3, 2), "in_time": (2, 1), "out_of_time": (1, 1)}


def test_counted_rows_stand_for_all(spark, panel):
    """Fits, errors, correlations and discrimination of different rows with their numbers are those of all rows."""
    few = panel.selectExpr("1D AS x0", "round(a) AS x1", "round(b) AS x2", "round(a) * round(b) AS x3", "double(y) AS y")
    cells = estimate.counted(few).persist()
    assert cells.count() < 200
    trials = {"one": [0, 1], "all": [0, 1, 2, 3]}
    every, own = estimate.newton_many(few, trials, rate=0.3), estimate.newton_many(cells, trials, rate=0.3)
    for name, cols in trials.items():
        assert own[name][3] == 4000 and np.allclose(own[name][0], every[name][0], atol=1e-10) and np.allclose(own[name][1], every[name][1])
        assert np.allclose(estimate.meats(cells, {name: (cols, own[name][0])})[name], estimate.meats(few, {name: (cols, own[name][0])})[name])
    assert np.allclose(binning.gram(cells, ["x1", "x2", "x3"], "n"), binning.gram(few, ["x1", "x2", "x3"]), atol=1e-8)
    plain = evaluate.discrimination(few.withColumn("p", F.col("x1"))).first()
    assert evaluate.discrimination(cells.groupBy(F.col("x1").alias("p")).agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("y")), weight="n").first() == plain


def test_joint_fits_are_those_of_the_rows_that_have_the_columns(spark, data):
    a, b, _, _, _, y = data
    a, b = 3 * np.round(a, 1), np.where(np.arange(len(y)) % 9 == 0, np.nan, np.round(b, 1))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), y.tolist(), strict=True)), "a double, b double, y int").selectExpr("a", "nanvl(b, null) AS b", "y")
    found = {r.combo: r for r in search.joint_fits(df, "y", {"a": ["a"], "b": ["b"], "a+b": ["a", "b"]}).collect()}
    for name, x in (("a", [a]), ("b", [b]), ("a+b", [a, b])):
        kept = ~np.isnan(sum(x))
        z = np.column_stack([np.ones(len(y)), *x])[kept]
        beta = logit_fit(z, y[kept])[0]
        p = 1 / (1 + np.exp(-z @ beta))
        ll = np.where(y[kept] == 1, np.log(p), np.log(1 - p)).sum()
        r = found[name]
        assert r.n == kept.sum() and np.abs(np.array(r.beta) - beta).max() <= 5.1e-9 and r.log_likelihood == pytest.approx(ll, abs=1e-5)
        assert r.bic == pytest.approx(len(beta) * np.log(y[kept].sum()) - 2 * ll, abs=2e-5)
