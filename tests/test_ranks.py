"""Quantiles and running totals against plain ones, whatever the order in which rows arrive."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from riskpanel.operators import ranks


def test_quantiles_are_those_of_the_sql(spark):
    r = random.Random(5)
    same = [round(r.uniform(-9e4, 9e4), 2) for _ in range(60)]
    rows = [(g, same[g] if g < 60 else round(r.uniform(-9e4, 9e4), 2)) for g in range(120) for _ in range(r.randint(1, 60))]
    fractions = [i / n for n in (8, 12, 30) for i in range(1, n)]
    found = {x.g: x.q for x in ranks.quantiles(spark.createDataFrame(rows, "g int, v double"), "v", fractions, ["g"]).collect()}
    t = pd.DataFrame(rows, columns=["g", "v"])  # noqa: F841
    assert found == dict(duckdb.sql(f"SELECT g, quantile_cont(v, {fractions}) FROM t GROUP BY 1").fetchall())
    assert ranks.quantiles(spark.createDataFrame([], "v double"), "v", [0.1, 0.5]).first().q == [None, None]


def test_order_of_arrival_does_not_matter(spark):
    """Each evaluation sees the rows in another order, as tasks that fetch from several machines do."""

    def mixed(parts):
        for p in parts:
            yield p.sample(frac=1.0, random_state=int.from_bytes(random.SystemRandom().randbytes(4)))

    n = 200_000
    values = spark.range(n).selectExpr("id * id % 999983 + id / 1000000 AS v", "1L AS n").repartition(8)
    counts = values.mapInPandas(mixed, "v double, n long")
    rows = ranks.running_totals(counts, "v", ["n"]).select("v", "before_n", "all_n").toPandas().sort_values("v")
    assert len(rows) == n and (rows["before_n"].to_numpy() == np.arange(n)).all() and (rows["all_n"] == n).all()
    fractions = [0.1, 0.25, 1 / 3, 0.9]
    assert "percentile_approx" not in ranks.running_totals(counts, "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert ranks.quantiles(counts, "v", fractions).first().q == pytest.approx(list(np.quantile(rows["v"], fractions)), rel=1e-12)
