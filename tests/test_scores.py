"""Totals by score: rows without a score are left out, and the score is computed once."""

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import evaluate


@pytest.mark.parametrize("weight", [None, "w"])
def test_a_score_is_computed_once(spark, monkeypatch, weight):
    rows = [("a", 0.5, 1, 1), ("a", 0.5, 0, 2), ("a", 0.1, 0, 1), ("b", 0.1, 1, 3), ("b", None, 1, 1), ("b", 0.9, None, 1), ("c", None, 0, 1)]
    scored = spark.createDataFrame(rows, "g string, x double, y int, w int").withColumn("p", F.cosh("x"))
    with monkeypatch.context() as m:
        m.setattr(evaluate, "running_totals", lambda table, *_: table)
        assert evaluate.by_score(scored, ["g"], weight)._jdf.queryExecution().optimizedPlan().toString().upper().count("COSH(") == 1
    found = evaluate.by_score(scored, ["g"], weight)
    score = {x: v for x, v in scored.select("x", "p").distinct().collect()}
    n = {("a", 0.5): 3, ("a", 0.1): 1, ("b", 0.1): 3} if weight else {("a", 0.5): 2, ("a", 0.1): 1, ("b", 0.1): 1}
    assert {(r.g, r.p): (r.n, r.e, r.all_n) for r in found.collect()} == {(g, score[x]): (k, 0 if (g, x) == ("a", 0.1) else 1, sum(m for (h, _), m in n.items() if h == g)) for (g, x), k in n.items()}
