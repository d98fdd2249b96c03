"""Identities, recomputation in numpy, gates and round trips of the panel operators."""

import json
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.functions import exprs, special
from riskpanel.operators import binning, curves, estimate, evaluate, losses, macro, ranks
from riskpanel.plans import specs
from riskpanel.sources import tape


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rates_and_bins(spark):
    assert value(spark, exprs.deannualize(exprs.annualize(F.lit(0.01)))) == pytest.approx(0.01)
    assert [value(spark, exprs.bin_index(F.lit(x).cast("double"), [1.0, 2.0])) for x in (0, 1, 1.5, 2, None)] == [0, 1, 1, 2, -1]
    paid = [value(spark, exprs.scheduled_balance(F.lit(1200.0), F.lit(0.12), F.lit(12), F.lit(t))) for t in (0, 6, 12)]
    assert paid[0] == pytest.approx(1200) and 0 < paid[1] < 1200 and paid[2] == 0
    assert value(spark, exprs.scheduled_balance(F.lit(1200.0), F.lit(0.12), F.lit(None).cast("int"), F.lit(5))) == 1200


def test_tails():
    assert special.normal_tail(1.959963985) == pytest.approx(0.05, rel=1e-6)
    assert special.chi2_tail(3.841458821, 1) == pytest.approx(0.05, rel=1e-6)
    assert special.chi2_tail(18.307038053, 10) == pytest.approx(0.05, rel=1e-6)
    lo, hi = special.jeffreys_interval(5, 50)
    assert special.beta_cdf(lo, 5.5, 45.5) == pytest.approx(0.025, abs=1e-9) and special.beta_cdf(hi, 5.5, 45.5) == pytest.approx(0.975, abs=1e-9)
    assert special.jeffreys_interval(0, 10)[0] == 0 and special.jeffreys_interval(10, 10)[1] == 1


def test_quantiles_and_ranks_are_exact(spark):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=3000), 2)
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)], "g int, v double")
    for row in ranks.quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1], ["g"]).collect():
        assert row.q == pytest.approx(np.quantile(x[row.g :: 3], [0, 0.1, 0.5, 0.99, 1]).tolist())
    assert ranks.quantiles(df.filter("g = 9"), "v", [0.5], ["g"]).count() == 0


def test_auc_matches_all_pairs(spark):
    r = np.random.default_rng(2)
    p, y = np.round(r.random(400), 1), (r.random(400) < 0.3).astype(int)
    found = evaluate.discrimination(spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int")).first()
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    assert found.auc == pytest.approx(((a > b) + 0.5 * (a == b)).mean(), abs=1e-7)
    assert found.ks == pytest.approx(max(abs((p[y == 1] <= c).mean() - (p[y == 0] <= c).mean()) for c in np.unique(p)), abs=1e-7)


def cube(spark):
    r = np.random.default_rng(4)
    rows = []
    for a in range(40):
        for t in range(1, 13):
            pd, lgd, ead, df = r.uniform(0, 0.012), r.uniform(0, 0.45), r.uniform(0, 1e5), 1 / 1.004**t
            rows += [("base", a, t, "x", ead, pd, lgd, ead, df), ("stress", a, t, "x", ead, min(2.4 * pd, 1.0), lgd, 1.08 * ead, df)]
    made = spark.createDataFrame(rows, "scenario string, account_id long, t int, segment string, current_balance double, pd double, lgd double, ead double, df double")
    return losses.with_survival(made).persist()


def test_losses_reconcile(spark):
    rows = cube(spark)
    one = rows.filter("scenario = 'base' AND account_id = 3").orderBy("t").collect()
    assert one[0].survival == 1
    assert one[-1].survival == pytest.approx(math.prod(1 - r.pd for r in one[:-1]))
    ecl = {r.scenario: r.ecl for r in losses.losses(rows).collect()}
    steps = losses.bridge(rows, "base", "stress").orderBy("step").collect()
    assert sum(s.delta for s in steps[:-1]) == pytest.approx(ecl["stress"], rel=1e-6) and steps[0].running == pytest.approx(ecl["base"], rel=1e-6)
    assert sum(r.contribution for r in losses.shapley(rows, "base", "stress").collect()) == pytest.approx(ecl["stress"] - ecl["base"], rel=1e-6)
    assert ecl["stress"] > ecl["base"]


@pytest.mark.parametrize("rule", ["avg", "sum", "eop"])
@pytest.mark.parametrize("scale", [1.0, 3e4, 1e-3])
def test_benchmarked_months_meet_the_quarters(rule, scale):
    q = np.random.default_rng(5).uniform(1, 2, 12) * scale
    m = macro.denton_cholette(q, rule)
    assert macro.aggregation_matrix(12, 3, rule) @ m == pytest.approx(q, rel=1e-10)
    with pytest.raises(ValueError):
        macro.aggregation_matrix(2, 3, "max")


def test_unit_root(spark):
    r = np.random.default_rng(6)
    assert macro.adf_statistic(r.normal(size=200))[0] < macro.ADF_CRITICAL < macro.adf_statistic(np.cumsum(np.random.default_rng(7).normal(size=200)))[0] + 1.5


def test_logistic_fit_matches_numpy(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(2000, 2))
    y = (r.random(2000) < 1 / (1 + np.exp(-(x @ [0.8, -0.5] - 1)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    model = estimate.fit_logistic(df, "y", {"a": "scaled", "b": "scaled"})
    d = np.column_stack([np.ones(2000), (x - x.mean(axis=0)) / x.std(axis=0)])
    beta = np.zeros(3)
    for _ in range(20):
        p = 1 / (1 + np.exp(-d @ beta))
        beta = beta + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d, d.T @ (y - p))
    assert model.beta == pytest.approx(beta.tolist(), abs=1e-6)
    again = estimate.Model.from_json(model.to_json())
    score = df.select(again.score().alias("p")).toPandas()["p"].to_numpy()
    assert score == pytest.approx(1 / (1 + np.exp(-d @ beta)), abs=1e-6)
    robust = estimate.fit_logistic(df.withColumn("y", F.col("y") * 0.5 + 0.1), "y", {"a": "scaled"}, robust=True)
    assert all(0 < s < 1 for s in robust.se)


def test_binning_merges_and_corrections(spark):
    assert binning.merged_edges([1, 2, 3], [100, 100, 100, 100], [5, 10, 4, 20]) != [1, 2, 3]
    counts = spark.createDataFrame([("c", 0, 100, 0), ("c", 1, 100, 10)], "name string, bin int, n long, events long")
    woe = {r.bin: r for r in binning.woe_table(counts).collect()}
    assert woe[0].woe == pytest.approx(math.log((0.5 / 10) / (100.5 / 190)))
    assert binning.clusters(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]])) == [0, 0, 1]
    m = np.array([[1, 0.5], [0.5, 1]])
    assert binning.generalised_vif(m, {"a": [0], "b": [1]})["a"] == pytest.approx(1 / 0.75)


def test_curves():
    assert curves.turning_points([0, 1, 2, 1, 0, 3], 0.5) == 2


def seller(spark, extra=()):
    rows = [(f"L{a:05d}", f"2022-{m:02d}-01", int(a == 3 and m == 12), 10_000 - 300 * m, 600 + a) for a in range(5) for m in range(1, 13)] + list(extra)
    return spark.createDataFrame(rows, "LoanNumber string, AsOfDate string, DefaultInd int, UPB int, OrigFICO int")


def test_tape_gates(spark, tmp_path):
    df = seller(spark)
    mapping = tape.suggest_mapping(df.columns)
    assert mapping == {"account_id": "LoanNumber", "performance_date": "AsOfDate", "default_flag": "DefaultInd", "current_balance": "UPB"}
    record = tape.ingest(spark, df, mapping, str(tmp_path), "demo")
    assert record["n_rows"] == 60 and any("severity" in w for w in record["warnings"])
    panel = spark.read.parquet(f"{tmp_path}/demo/panel")
    assert panel.count() == 60 and dict(panel.dtypes)["default_flag"] == "tinyint" and "OrigFICO" in panel.columns
    assert json.loads(tape.registry(spark, str(tmp_path)).first().record)["key"] == "demo"
    for bad in ([("L00000", "2022-01-01", 0, 1, 1)], [("L9", "2022-01-01", 2, 1, 1)]):
        with pytest.raises(tape.TapeError):
            tape.ingest(spark, seller(spark, bad), mapping, str(tmp_path), "bad")
    with pytest.raises(tape.TapeError):
        tape.ingest(spark, df, {k: v for k, v in mapping.items() if k != "default_flag"}, str(tmp_path), "bad")


def test_versions(spark, tmp_path):
    a = {"variables": [{"column": "x", "knots": 2.0}], "seed": 1}
    b = {"variables": [{"column": "x", "knots": 3}, {"column": "z"}], "seed": 1}
    assert specs.identity(a) == specs.identity({"seed": 1.0, "variables": [{"column": "x", "knots": 2}]}) != specs.identity(b)
    assert specs.changes(a, b) == [("added", "z"), ("changed", "x.knots")]
    store = specs.Versions(spark, str(tmp_path / "v"))
    first = store.save(a, {"auc": 0.7})
    second = store.save(b, {"auc": 0.8}, parent=first)
    assert store.lineage(second) == [second, first] and store.table().count() == 2
    combos = list(specs.enumerate_combos([("gdp", "level", 0), ("gdp_yoy", "level", 0), ("u", "diff", 3)], 2))
    assert len(combos) == 5 and len(combos) == 3 + sum(1 for p in combinations(range(3), 2) if p != (0, 1))


def test_sampling_keeps_events(spark):
    df = spark.range(10_000).select(F.col("id").alias("account_id"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    kept, share = evaluate.event_sample(df, "y", 2000, ["account_id"])
    assert kept.filter("y = 1").count() == 100 and abs(kept.count() - 2000) < 200 and 0.1 < share < 0.3
    half = df.filter(evaluate.split_by_account(df, 0.3)).count()
    assert abs(half - 3000) < 300
