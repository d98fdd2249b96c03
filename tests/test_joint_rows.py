"""Joint fits take all rows before the boundary, however many there are, and read them once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import estimate
from riskpanel.plans import search

N = 420_000  # beyond the rows of a search frame


def fit(x, y, n):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (n * p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (n * (y - p)))
    p = 1 / (1 + np.exp(-x @ beta))
    return (n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(), p


def test_all_rows_are_fitted_and_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(N).selectExpr("id % 7D AS a", "id % 11D AS b", "int(id % 97 < 4 + id % 7) AS y", "CASE WHEN id % 20 = 0 THEN DATE'2012-07-01' ELSE DATE'2012-06-01' END AS performance_date")
    out = search.joint_rows(rows.mapInArrow(counted, rows.schema), "y", "2012-07-01", {"x": ["a"]}, {"a": "scaled"}, [("b",)], {"b": None})
    found = {tuple(r.terms): r for r in out.collect()}
    assert reads.value == N
    i = np.arange(N)
    a, b, y, early = i % 7.0, i % 11.0, (i % 97 < 4 + i % 7).astype(float), i % 20 > 0
    cells, n = np.unique(np.column_stack([a, b, y])[early], axis=0, return_counts=True)
    for terms, x in (((), cells[:, :1]), (("b",), cells[:, :2])):
        ll, p = fit(np.column_stack([np.ones(len(x)), x]), cells[:, 2], n)
        r = found[terms]
        assert (r.n, r.events) == (early.sum(), y[early].sum()) and r.log_likelihood == pytest.approx(ll, rel=1e-9)
        e, g = np.where(cells[:, 2] == 1, n, 0), np.where(cells[:, 2] == 0, n, 0)
        order = np.unique(np.round(p, 12), return_inverse=True)[1]
        e, g = np.bincount(order, e), np.bincount(order, g)
        assert r.auc_in == pytest.approx((e * (np.cumsum(g) - g / 2)).sum() / (e.sum() * g.sum()), abs=1e-8)


def test_terms_of_counted_rows_are_those_of_all(spark):
    r = np.random.default_rng(8)
    rows = [(None if i % 13 == 0 else float(v), None if i % 17 == 0 else "pqrs"[int(w)], int(1990 + w), int(y)) for i, (v, w, y) in enumerate(zip(r.integers(0, 40, 3000), r.integers(0, 4, 3000), r.random(3000) < 0.3, strict=True))]
    df = spark.createDataFrame(rows, "v double, s string, year int, y int").selectExpr("y", *[f"v AS {c}" for c in ("scaled", "hinges", "spline", "woe", "dummies", "ordinal")], "s AS woe_levels", "s AS dummy_levels", "year AS vintage")
    hows = {c: c for c in df.columns if c != "y"}
    cells = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    assert cells.count() < 1200
    for a, b in zip(estimate.fit_terms(df, "y", hows), estimate.fit_terms(cells, "y", hows, weight="_n"), strict=True):
        assert (a.column, a.treatment, list(a.levels)) == (b.column, b.treatment, list(b.levels)) and a.edges == b.edges
        for x, z in ((a.mean, b.mean), (a.sd, b.sd), (a.missing, b.missing), (a.center, b.center), (a.matrix, b.matrix), (list(a.levels.values()), list(b.levels.values()))):
            assert np.allclose(x, z, rtol=1e-9, atol=1e-12), a.column
