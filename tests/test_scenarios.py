"""Macro paths, stored models over them, tapes and cohorts: small cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskpanel.functions import special
from riskpanel.operators import curves, evaluate, losses, macro, quality, scenarios
from riskpanel.sources import tape


def month(i):
    return dt.date(1998 + i // 12, i % 12 + 1, 1)


def series(spark, values, key="x", start=0):
    return spark.createDataFrame([(key, month(start + i), float(v)) for i, v in enumerate(values)], "key string, month date, value double")


def test_turning_points():
    assert curves.turning_points([0, 2, 4, 6, 8, 10, 8, 6, 4, 2, 0], 3) == 1  # a smooth hump
    assert curves.turning_points([0, 1, 0, 1, 0], 3) == 0
    assert curves.turning_points([0, 5, 4.5, 9, 1, 1.5, 0, 7], 2) == 2
    assert curves.turning_points([], 1) == curves.turning_points([4], 1) == curves.turning_points([4, 4, 4], 1) == 0
    assert curves.turning_points([5, 0, 0, 5, 0], 4.9) == 2 and curves.turning_points([1, 2, 3, 9], 0.5) == 0


def test_cohort_intervals(spark):
    rows = [(i, dt.date(1999, 1, 1) if i < 1000 else dt.date(1999, 4, 1), int(i % 50 == 0), 0.02 if i < 1000 else 0.2) for i in range(2000)]
    scored = spark.createDataFrame(rows, "account_id long, performance_date date, y int, p double")
    found = {r.period: r for r in evaluate.with_intervals(evaluate.cohorts(scored)).collect()}
    lo, hi = special.jeffreys_interval(20, 1000)
    first, second = found[dt.date(1999, 1, 1)], found[dt.date(1999, 4, 1)]
    assert first.covered and not second.covered
    assert abs(first.low - lo) < 1e-6 and abs(first.high - hi) < 1e-6 and lo < 0.02 < hi


def test_paths_are_spliced_overridden_and_capped(spark):
    history = series(spark, range(100, 124))
    path = series(spark, [200] * 12, start=24).withColumn("scenario", F.lit("s"))
    change = spark.createDataFrame([("s", "x", month(25), 300.0)], "scenario string, key string, month date, value double")
    out = scenarios.scenario_paths(history, path, overrides=change)
    values = {r.month: (r.value, r.projected) for r in out.collect()}
    assert values[month(23)] == (123.0, False) and values[month(24)] == (200.0, True) and values[month(25)] == (300.0, True)
    terms = scenarios.term_columns(out, [("x", "yoy", 2)], ["scenario"])
    found = {r.month: r["x@yoy@2"] for r in terms.collect()}
    assert abs(found[month(26)] - 100 * (200 / 112 - 1)) < 1e-9  # growth of the spliced series, two months later
    capped = {r.month: r["x@yoy@2"] for r in scenarios.winsorized(terms, ["x@yoy@2"], str(month(23)), str(month(0))).collect()}
    top = max(v for m, v in found.items() if v is not None and m <= month(23))
    assert capped[month(26)] == top and capped[month(20)] == found[month(20)]
    rebased = {r.month: r.value for r in scenarios.scenario_paths(history, path, ["x"]).collect()}
    assert rebased[month(24)] == 123.0


def test_signs_and_exposure_statements():
    assert [x[3] for x in scenarios.sign_checks({"a": 0.5, "b": 0.5, "c": 1.0}, {"a": 1, "b": -1})] == ["agrees", "contradicts", "no prior"]
    assert losses.exposure_assumption(["committed_amount"], ccf=0.19)["statement"] == "Exposure is what is drawn and 19 % of what is not."
    assert losses.exposure_assumption(["interest_rate", "remaining_term"])["method"] == "amortising" and losses.exposure_assumption([])["method"] == "flat"
    with pytest.raises(ValueError):
        losses.exposure_assumption([], "other")


def test_exposure_by_ccf(spark):
    book = spark.createDataFrame([(1, 40.0, 100.0), (2, 120.0, 100.0)], "account_id long, current_balance double, committed_amount double")
    assert sorted((r.account_id, r.t, r.ead) for r in losses.exposure_by_ccf(book, 2, 0.5).collect()) == [(1, 1, 70.0), (1, 2, 70.0), (2, 1, 120.0), (2, 2, 120.0)]


def test_tapes_are_peeked_remapped_and_removed(spark, tmp_path):
    rows = [(f"L{i // 3}", f"2022-0{i % 3 + 1}-01", "0", str(100 + i), "1") for i in range(30)]
    df = spark.createDataFrame(rows, "Loan string, AsOf string, Bad string, UPB string, Other string")
    first = {"account_id": "Loan", "performance_date": "AsOf", "default_flag": "Bad", "current_balance": "UPB"}
    mapped = tape.mapped(df, first)
    again = tape.remapped(mapped, first, {**{k: first[k] for k in tape.REQUIRED}, "current_balance": "Other"})
    assert set(again.columns) == {"account_id", "performance_date", "default_flag", "UPB", "current_balance"} and again.first().current_balance == "1"
    with pytest.raises(tape.TapeError):
        tape.remapped(mapped, first, {**first, "account_id": "Other"})
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/t.csv")
    sample, n = tape.peek(spark, f"{tmp_path}/t.csv", 5)
    assert n == 30 and sample.count() == 5
    root = f"{tmp_path}/books"
    tape.ingest(spark, df, first, root, "one")
    tape.ingest(spark, df, first, root, "two")
    spark.createDataFrame([("bad", "{")], "key string, record string").write.json(f"{root}/bad/registry")
    assert sorted(r.key for r in tape.registry(spark, root).collect()) == ["one", "two"]
    assert tape.remove(spark, root, "one") and not tape.remove(spark, root, "one")
    assert [r.key for r in tape.registry(spark, root).collect()] == ["two"]


def test_quarters_become_months(spark):
    quarters = spark.createDataFrame([("x", month(3 * i), float(30 + i)) for i in range(6)], "key string, month date, value double")
    months = macro.to_monthly(quarters, "Q", "sum")
    assert months.count() == 18
    check = macro.aggregation_residual(months, quarters.select("key", F.col("month").alias("period"), "value"), "sum").first()
    assert check.periods == 6 and check.identity_holds


def test_shrinkage_counts_levels_before_grouping(spark):
    from riskpanel.operators import binning

    rows = [(f"l{i % 25}", int(i % 10 == 0)) for i in range(5000)]
    woe = binning.categorical_screen(spark.createDataFrame(rows, "c string, y int"), ["c"], "y").collect()
    k = max(500 / 25, 5)
    e, g = 500, 4500
    other = next(r for r in woe if r.bin == "Other")
    import math

    raw = math.log(other.events / e / ((other.n - other.events) / g)) if other.events else 0
    assert abs(other.woe - raw * other.events / (other.events + k)) < 1e-9


def test_catalogue_of_names():
    assert [quality.unit_of(c) for c in ("account_id", "interest_rate", "current_balance", "original_ltv", "num_trades", "fico_orig", "vintage")] == ["identifier", "decimal_rate", "currency", "percent", "count", "score", "number"]
    assert [quality.role_of(c, drivers=["dti"]) for c in ("account_id", "dti", "default_flag", "lgd_realised", "zip_numeric", "channel")] == ["identifier", "driver", "target", "outcome", "other", "candidate"]
