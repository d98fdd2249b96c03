"""Evaluation of scores: discrimination, calibration, gains, cohorts, segments, vintages.

A scored panel has performance_date, y and p. Ranks come from totals by distinct score, so no task sorts all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import annualize, clamp, log_product, period_of
from ..functions.special import chi2_tail, jeffreys_interval
from .ranks import quantiles, running_totals


def by_score(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per score (within by): n, e, and before_ and all_ totals of both. weight: a column of counts, of which y has the sums.

    Rows without a score go after the grouping, by a count: as a filter on p Spark would evaluate the whole score once more, and slowly.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counted = scored.filter("y IS NOT NULL").groupBy(*by, "p").agg(rows.alias("n"), F.sum("y").alias("e"), F.count("p").alias("_scored"))
    return running_totals(counted.filter("_scored > 0").drop("_scored"), "p", ["n", "e"], by)


def discrimination(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """AUC (ties count half), Gini and KS, with the score at the greatest gap; null without both outcomes. weight: as by_score has it."""
    t = by_score(scored, by, weight)
    good = F.col("all_n") - F.col("all_e")
    gap = F.abs((F.col("before_e") + F.col("e")) / F.col("all_e") - (F.col("before_n") + F.col("n") - F.col("before_e") - F.col("e")) / good)
    out = t.withColumn("_gap", F.round(gap, 12)).groupBy(*by).agg(
        F.sum(F.col("e") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("r"), F.max("all_e").cast("double").alias("E"), F.max("all_n").alias("N"),
        F.max("_gap").alias("ks"), F.max(F.struct("_gap", -F.col("p"))).alias("_at"),
    )
    auc = (F.col("r") - F.col("E") * (F.col("E") + 1) / 2) / F.nullif(F.col("E") * (F.col("N") - F.col("E")), F.lit(0.0))
    return out.select(*by, F.col("N").alias("n"), F.col("E").cast("long").alias("events"), F.round(auc, 8).alias("auc"), F.round(2 * auc - 1, 8).alias("gini"), F.round("ks", 8).alias("ks"), F.round(-F.col("_at").getField("col2"), 8).alias("ks_score"))


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss, and actual and predicted annual rates."""
    p = clamp(F.col("p"), 1e-12, 1 - 1e-12)
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))), 8).alias("brier"), F.round(F.avg(loss), 8).alias("log_loss"),
        F.round(annualize(F.avg("y")), 6).alias("actual_annual"), F.round(annualize(F.avg("p")), 6).alias("predicted_annual"),
    )


def curve_points(scored: DataFrame, points: int = 120) -> DataFrame:
    """ROC points: for each of the point numbers the rates at the least score rank that reaches it."""
    t = by_score(scored).withColumns({"above_n": F.col("all_n") - F.col("before_n"), "above_e": F.col("all_e") - F.col("before_e")})
    at = F.ceil(F.col("above_n") * points / F.col("all_n")).cast("int")
    tpr, fpr = F.col("above_e") / F.col("all_e"), (F.col("above_n") - F.col("above_e")) / (F.col("all_n") - F.col("all_e"))
    return t.groupBy(at.alias("point")).agg(F.round(F.max(tpr), 8).alias("tpr"), F.round(F.max(fpr), 8).alias("fpr"))


def gains(scored: DataFrame, groups: int = 10) -> DataFrame:
    """Groups of falling score with cuts at floor(n * g / groups); rows of one score that a cut divides share its events evenly."""
    t = by_score(scored)
    above = F.col("all_n") - F.col("before_n") - F.col("n")  # rows of higher scores
    cut = lambda g: F.floor(F.col("all_n") * g / groups)
    parts = t.select("*", above.alias("above"), F.explode(F.sequence(F.lit(1), F.lit(groups))).alias("decile"))
    own = F.greatest(F.lit(0), F.least(F.col("above") + F.col("n"), cut(F.col("decile"))) - F.greatest(F.col("above"), cut(F.col("decile") - 1)))
    parts = parts.withColumn("own", own).filter("own > 0")
    out = parts.withColumn("_events", F.col("e") * F.col("own") / F.col("n")).groupBy("decile").agg(F.sum("own").alias("rows"), F.sum("_events").alias("events"), (F.sum(F.col("p") * F.col("own")) / F.sum("own")).alias("mean_predicted"), F.max("all_e").alias("E"), F.max("all_n").alias("N"))
    cum = F.sum("events").over(Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0))
    rate = F.col("events") / F.col("rows")
    return out.select("decile", F.col("rows").alias("n"), F.round("events", 6).alias("events"), F.round(rate, 8).alias("event_rate"), F.round("mean_predicted", 8).alias("mean_predicted"), F.round(100 * F.col("events") / F.col("E"), 6).alias("capture_pct"), F.round(100 * cum / F.col("E"), 6).alias("cumulative_pct"), F.round(rate / (F.col("E") / F.col("N")), 6).alias("lift"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """By bin of predicted rate (exact quantile edges): n, events, predicted, observed and the bin's part of the Hosmer-Lemeshow statistic."""
    edges = quantiles(scored, "p", [i / bins for i in range(1, bins)], to="edges").select(F.array_distinct("edges").alias("edges"))
    rows = scored.filter("p IS NOT NULL").crossJoin(F.broadcast(edges))
    out = rows.groupBy((F.size(F.filter("edges", lambda e: e <= F.col("p"))) + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.sum("p").alias("expected"))
    x, n = F.col("expected"), F.col("n")
    part = F.when((x > 0) & (x < n), F.pow(F.col("events") - x, F.lit(2)) / (x * (1 - x / n))).otherwise(0.0)
    return out.select("bin", "n", "events", F.round(x / n, 8).alias("predicted"), F.round(F.col("events") / n, 8).alias("observed"), F.round(part, 6).alias("hl_part"))


def hosmer_lemeshow(table: DataFrame) -> tuple[float, float]:
    """Statistic and p-value from a calibration table, which has a row per bin."""
    parts = [r.hl_part for r in table.select("hl_part").collect()]
    return sum(parts), chi2_tail(sum(parts), max(len(parts) - 2, 1))


def hosmer_lemeshow_table(table: DataFrame) -> DataFrame:
    """The test of a calibration table as a row: groups, statistic, df and p_value."""
    stat, p = hosmer_lemeshow(table)
    groups = table.count()
    return table.sparkSession.createDataFrame([(groups, float(stat), max(groups - 2, 1), float(p))], "groups int, statistic double, df int, p_value double")


def coverage(table: DataFrame, boundary: str) -> DataFrame:
    """Of a cohort table with intervals: in how many periods, all and before and from the boundary on, the predicted rate lies within."""
    cut = F.when(F.col("period") < F.lit(boundary).cast("date"), "in_time").otherwise("out_of_time")
    rows = table.select("covered", F.explode(F.array(F.lit("all"), cut)).alias("slice"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("periods"), F.count_if("covered").alias("covered"), F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"))


def cohorts(scored: DataFrame, freq: str = "QS", least: int = 400) -> DataFrame:
    """By period with enough rows: actual and predicted rates, AUC, Gini and KS."""
    own = scored.withColumn("period", period_of(F.col("performance_date"), freq))
    sizes = own.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("actual"), F.avg("p").alias("predicted")).filter(F.col("n") >= least)
    d = discrimination(own, ["period"]).select("period", "events", "auc", "gini", "ks")
    return sizes.join(d, "period").select("period", "n", "events", F.round("actual", 8).alias("actual"), F.round("predicted", 8).alias("predicted"), "auc", "gini", "ks")


def with_intervals(table: DataFrame) -> DataFrame:
    """A cohort table, which is small, with Jeffreys intervals of the actual rate and whether the predicted one is inside."""
    rows = [(*r, *jeffreys_interval(r.events, r.n)) for r in table.collect()]
    out = table.sparkSession.createDataFrame(rows, table.schema.add("low", "double").add("high", "double"))
    return out.withColumn("covered", F.col("predicted").between(F.col("low"), F.col("high")))


def error_summary(table: DataFrame, boundary: str) -> DataFrame:
    """Of a cohort table: errors of all periods, and before and from the boundary on; in annual percent."""
    error = annualize(F.col("predicted")) - annualize(F.col("actual"))
    cut = F.when(F.col("period") < F.lit(boundary).cast("date"), "in_time").otherwise("out_of_time")
    rows = table.select("period", "n", error.alias("err"), F.col("actual"), F.col("predicted"), F.explode(F.array(F.lit("all"), cut)).alias("slice"))
    return rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("periods"), F.round(F.avg(F.abs("err")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 6).alias("rmse"), F.round(F.avg("err"), 6).alias("bias"),
        F.round(F.sum("predicted") / F.sum("actual"), 6).alias("ratio"), F.max_by("period", F.struct(F.round(F.abs("err"), 9), "period")).alias("worst"),
    )


def segments(scored: DataFrame, column: str, least: int = 2000) -> DataFrame:
    """By level of a column with enough rows: AUC, its difference from the whole's, and bias in percent."""
    big = scored.groupBy(column).agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("actual"), F.avg("p").alias("predicted")).filter(F.col("rows") >= least)
    d = discrimination(scored, [column]).select(column, "auc")
    whole = discrimination(scored).select(F.col("auc").alias("_whole"))
    return big.join(d, column).crossJoin(F.broadcast(whole)).select(F.col(column).alias("segment"), F.col("rows").alias("n"), "auc", F.round(F.col("auc") - F.col("_whole"), 8).alias("delta"), F.round(100 * (F.col("predicted") / F.col("actual") - 1), 6).alias("bias_pct"))


def rank_order(scored: DataFrame, bands: int = 5, freq: str = "QS", least: int = 800) -> DataFrame:
    """By period with enough rows whether the rates of globally cut score bands rise: period, n, monotone."""
    edges = quantiles(scored, "p", [i / bands for i in range(1, bands)], to="edges")
    rows = scored.crossJoin(F.broadcast(edges)).groupBy(period_of(F.col("performance_date"), freq).alias("period"), F.size(F.filter("edges", lambda e: e <= F.col("p"))).alias("band")).agg(F.count(F.lit(1)).alias("c"), F.avg("y").alias("rate"))
    step = F.col("rate") - F.lag("rate").over(Window.partitionBy("period").orderBy("band"))
    out = rows.withColumn("_step", step).groupBy("period").agg(F.sum("c").alias("n"), F.coalesce(F.bool_and(F.col("_step") >= -1e-12), F.lit(True)).alias("monotone"))
    return out.filter(F.col("n") >= least)


def vintage_curves(panel: DataFrame, target: str = "default_flag", max_mob: int = 84, least: int = 2000) -> DataFrame:
    """Cumulative default percent by vintage and month on book, of vintages with enough rows."""
    cells = panel.filter((F.col("months_on_book") <= max_mob) & F.col("vintage").isNotNull()).groupBy("vintage", "months_on_book").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("e"))
    w = Window.partitionBy("vintage")
    survived = F.exp(F.sum(log_product(1 - F.col("e") / F.col("n"))).over(w.orderBy("months_on_book").rowsBetween(Window.unboundedPreceding, 0)))
    out = cells.withColumns({"_all": F.sum("n").over(w), "_s": survived}).filter(F.col("_all") >= least)
    return out.select("vintage", "months_on_book", "n", F.round(100 * (1 - F.col("_s")), 8).alias("cumulative_pct"))


def severity_over_time(rows: DataFrame, value: str, freq: str = "MS", least: int = 5) -> DataFrame:
    """Mean severity with a 95 % band for every period of the span; periods of fewer rows are there with nulls."""
    own = rows.filter(F.col(value).isNotNull()).groupBy(period_of(F.col("performance_date"), freq).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    step = {"MS": "1 month", "QS": "3 month", "YS": "1 year"}[freq]
    spine = own.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("period"))
    enough = F.col("n") >= least
    half = 1.96 * F.col("s") / F.sqrt("n")
    show = lambda c: F.round(F.when(enough, c), 8)
    return spine.join(own, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"), show(F.col("m")).alias("mean"), show(F.col("m") - half).alias("low"), show(F.col("m") + half).alias("high"))


def split_by_account(panel: DataFrame, fraction: float, seed: int = 0, account: str = "account_id") -> Column:
    """Whether a row is of a test account: the same for all rows of one account, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(account).cast("string")), F.lit(10_000)) < fraction * 10_000


def event_sample(rows: DataFrame, target: str, size: int, key: Sequence[str], seed: int = 0) -> tuple[DataFrame, float]:
    """All events, and non-events by a hash of their key so that about size rows remain; and the share of non-events that were kept."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("e")).first()
    share = min(1.0, max(0.0, (size - (n.e or 0)) / max(n.n - (n.e or 0), 1)))
    keep = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) < share * 1_000_000
    return rows.filter((F.col(target) == 1) | keep), share


def score_stability(scored: DataFrame, baseline_months: int = 12, least: int = 200) -> DataFrame:
    """Population stability of the score by quarter against the first months."""
    from .binning import psi_over_time

    return psi_over_time(scored, ["p"], baseline_months, "QS", least)


def severities(panel: DataFrame, severity: str = "lgd_realised", target: str = "default_flag") -> DataFrame:
    """Each default's month and severity."""
    return panel.filter((F.col(target) == 1) & F.col(severity).isNotNull()).select("account_id", F.col("performance_date").alias("month"), F.col(severity).alias("severity"))
