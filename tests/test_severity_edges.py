"""Bins and cohorts of severity and of shapes: edges as the SQL has them, and no approximate quantile left in a plan, which may differ at each evaluation."""

import random

import duckdb
import pandas as pd
import pytest

from riskpanel.operators import curves, forms, severity


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    prices = [round(r.uniform(900, 99_000), 2) for _ in range(900)]
    return [(x, r.choice(prices), round(r.random(), 1), r.random()) for x in range(4000)]


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "id int, price double, actual double, predicted double").selectExpr("*", "actual AS lgd_realised", "int(actual > 0.7) AS y")


def test_edges_of_severity_bins_are_those_of_the_sql(spark, rows):
    t = pd.DataFrame([(g, *x) for g in range(12) for x in rows[97 * g :]], columns=["g", "id", "price", "actual", "predicted"])
    wide = spark.createDataFrame(pd.DataFrame({f"p{g}": t[t.g == g].price.reset_index(drop=True) for g in range(12)} | {"lgd_realised": [x[2] for x in rows]}))
    columns = [f"p{g}" for g in range(12)]
    wide = wide.selectExpr("lgd_realised", *[f"nanvl({c}, null) AS {c}" for c in columns])
    found = {(x.column_name, x.bin): x.lo for x in severity.bins(wide, columns, most=8).collect() if x.bin}
    cuts = dict(duckdb.sql(f"SELECT 'p' || g, quantile_cont(price, {[i / 8 for i in range(1, 8)]}) FROM t GROUP BY 1").fetchall())
    assert found == {(c, i + 1): e for c, own in cuts.items() for i, e in enumerate(own)}


@pytest.mark.parametrize("query", [
    lambda p: severity.calibration(p), lambda p: severity.residual_curve(p), lambda p: curves.severity_curve(p, "price", "actual"), lambda p: forms.shapes(p, ["price", "predicted"], "y"),
], ids=["severity_calibration", "severity_residuals", "severity_curve", "shape_diagnostic"])
def test_marks_are_taken_once(panel, query):
    out = query(panel)
    assert out.count() > 1 and "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
