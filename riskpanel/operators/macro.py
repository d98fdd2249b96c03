"""Macro series in long form (key, month, value): frequency, benchmarking, transforms, splicing, candidate library.

Windows are by key. A series has a few hundred months, so a key's rows fit one task; keys are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import candidate_name, period_of



#: Names of the transforms of a macro term.
TRANSFORMS = ["level", "diff", "yoy", "log_diff", "qoq_annualized", "z_score", "four_quarter_change", "ma3", "ma6", "ma12", "yoy_ma3", "diff_ma3"]


def by_key():
    """The window of a series."""
    return Window.partitionBy("key").orderBy("month")


def down(df: DataFrame, rule: str, to: str = "QS", date: str = "month", value: str = "value") -> DataFrame:
    """A series at a lower frequency by rule: avg, sum, max or eop (the last value)."""
    how = {"avg": F.avg(value), "sum": F.sum(value), "max": F.max(value), "eop": F.max_by(value, date)}[rule]
    return df.groupBy("key", period_of(F.col(date), to).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.round(how, 6).alias("value"))


def _lag(x: Column | str, k: int) -> Column:
    return F.lag(x, k).over(by_key())


def _rolling(x: Column | str, k: int) -> Column:
    w = by_key().rowsBetween(-(k - 1), 0)
    return F.when(F.count(x).over(w) == k, F.avg(x).over(w))


def transformed(series: DataFrame, names: Sequence[str] = TRANSFORMS) -> DataFrame:
    """key, month, transform, value for each of the transforms; null where history is short, or where a ratio's base is 0."""
    v = F.col("value")
    ratio = lambda k: F.when(_lag(v, k) != 0, v / _lag(v, k))
    whole = Window.partitionBy("key")
    sd = F.stddev_pop(v).over(whole)
    first = series.withColumns({"level": v, "diff": v - _lag(v, 1), "yoy": 100 * (ratio(12) - 1)})
    floor = F.log(F.greatest(v, F.lit(1e-9)))
    every = first.withColumns(
        {
            "log_diff": floor - _lag(floor, 1), "qoq_annualized": 100 * (F.pow(ratio(3), F.lit(4)) - 1), "z_score": (v - F.avg(v).over(whole)) / F.when(sd == 0, 1.0).otherwise(sd),
            "four_quarter_change": v - _lag(v, 12), "ma3": _rolling(v, 3), "ma6": _rolling(v, 6), "ma12": _rolling(v, 12), "yoy_ma3": _rolling("yoy", 3), "diff_ma3": _rolling("diff", 3),
        }
    )
    parts = F.array(*[F.struct(F.lit(n).alias("transform"), F.col(n).alias("value")) for n in names])
    return every.select("key", "month", F.explode(parts).alias("x")).select("key", "month", "x.transform", "x.value")


def lagged(terms: DataFrame, lags: Sequence[int]) -> DataFrame:
    """candidate (key@transform@lag), key, transform, lag, month, value: each term shifted by whole months."""
    each = terms.select("*", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    moved = each.withColumn("month", F.add_months("month", F.col("lag")))
    return moved.select(candidate_name(F.col("key"), F.col("transform"), F.col("lag")).alias("candidate"), "key", "transform", "lag", "month", "value")


def target_log_odds(panel: DataFrame, target: str, least: int = 500) -> DataFrame:
    """month and log odds of the event rate, half an event added; months of fewer rows are left out."""
    g = panel.groupBy(F.col("performance_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("e")).filter(F.col("n") >= least)
    p = (F.col("e") + 0.5) / (F.col("n") + 1)
    return g.select("month", "n", F.log(p / (1 - p)).alias("y"))


def candidate_correlations(candidates: DataFrame, target: DataFrame, least: int = 24) -> DataFrame:
    """By candidate the correlation with the target, months in common, and the effective number after serial correlation."""
    both = candidates.filter("value IS NOT NULL").join(F.broadcast(target.select("month", "y")), "month").select("candidate", "month", F.col("value").alias("x"), "y")
    w = Window.partitionBy("candidate")
    s = w.orderBy("month")
    c = both.withColumns({"dx": F.col("x") - F.avg("x").over(w), "dy": F.col("y") - F.avg("y").over(w)})
    c = c.withColumns({"px": F.col("dx") * F.lag("dx").over(s), "py": F.col("dy") * F.lag("dy").over(s)})
    m = c.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum("px").alias("sx"), F.sum("py").alias("sy"),
    ).filter((F.col("n") >= least) & (F.col("xx") > 1e-12) & (F.col("yy") > 1e-12))
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), (F.col("sx") / F.col("xx")) * (F.col("sy") / F.col("yy"))))
    return m.select("candidate", "n", F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 7).alias("r"), F.round(F.greatest(F.lit(4.0), F.col("n") * (1 - rho) / (1 + rho)), 4).alias("n_effective"))


def level_from_growth(growth: DataFrame, periods_per_year: int, base: float = 100.0) -> DataFrame:
    """Index level from annualised growth in percent: value compounds from base."""
    w = by_key().rowsBetween(Window.unboundedPreceding, 0)
    return growth.withColumn("value", F.lit(base) * F.exp(F.sum(F.log(1 + F.col("value") / 100) / periods_per_year).over(w)))


def growth_from_level(level: DataFrame, periods_per_year: int) -> DataFrame:
    """Annualised growth in percent; null for the first period."""
    return level.withColumn("value", 100 * (F.pow(F.col("value") / _lag("value", 1), F.lit(periods_per_year)) - 1))


def filled(series: DataFrame) -> DataFrame:
    """Nulls take the last value before, or the first one after."""
    back = F.last("value", True).over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("value", True).over(by_key().rowsBetween(0, Window.unboundedFollowing))
    return series.withColumn("value", F.coalesce(back, ahead))


def spliced(history: DataFrame, path: DataFrame, rebased: Sequence[str] = ()) -> DataFrame:
    """History strictly before a key's first path month, then the path; the path of a rebased key is scaled to meet the last history value."""
    starts = path.groupBy("key").agg(F.min("month").alias("_start"), F.min_by("value", "month").alias("_first"))
    before = history.join(F.broadcast(starts), "key").filter("month < _start")
    last = before.groupBy("key").agg(F.max_by("value", "month").alias("_last"))
    scaled = path.join(starts, "key").join(last, "key", "left")
    ratio = F.when(F.col("key").isin(*rebased), F.coalesce(F.col("_last") / F.nullif("_first", F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    new = scaled.select("key", "month", (F.col("value") * ratio).alias("value"), F.lit(True).alias("projected"))
    return before.select("key", "month", "value", F.lit(False).alias("projected")).unionByName(new)


def extrapolation(series: DataFrame, as_of: str) -> DataFrame:
    """By key how many standard deviations the values after as_of leave the range before it."""
    past = F.col("month") <= F.lit(as_of).cast("date")
    v = F.col("value")
    m = series.groupBy("key").agg(F.min(F.when(past, v)).alias("lo"), F.max(F.when(past, v)).alias("hi"), F.stddev_pop(F.when(past, v)).alias("sd"), F.min(F.when(~past, v)).alias("least"), F.max(F.when(~past, v)).alias("most"))
    beyond = F.greatest(F.lit(0.0), F.col("most") - F.col("hi"), F.col("lo") - F.col("least"))
    return m.select("key", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round(beyond / F.nullif("sd", F.lit(0.0)), 6).alias("sd_beyond"))


def standardized(series: DataFrame, until: str) -> DataFrame:
    """(value - mean) / population sd of the months up to a date."""
    w = Window.partitionBy("key")
    ref = F.when(F.col("month") <= F.lit(until).cast("date"), F.col("value"))
    return series.withColumn("value", (F.col("value") - F.avg(ref).over(w)) / F.nullif(F.stddev_pop(ref).over(w), F.lit(0.0)))


def aggregation_matrix(periods: int, each: int, rule: str) -> np.ndarray:
    """Rows that take months to periods by avg, sum or eop."""
    weight = {"avg": np.full(each, 1 / each), "sum": np.ones(each), "eop": np.eye(each)[-1]}
    if rule not in weight:
        raise ValueError(f"no linear aggregation for {rule}")
    return np.kron(np.eye(periods), weight[rule][None, :])


def denton_cholette(totals: np.ndarray, rule: str, indicator: np.ndarray | None = None, each: int = 3) -> np.ndarray:
    """Monthly values that meet the totals exactly, whose ratio to the indicator changes least from month to month."""
    c = aggregation_matrix(len(totals), each, rule)
    n = c.shape[1]
    z = np.ones(n) if indicator is None else np.where(np.abs(indicator) < 1e-12, 1e-12, indicator)
    d = np.diff(np.eye(n), axis=0) / z[None, :]
    m = len(totals)
    kkt = np.block([[d.T @ d, c.T], [c, np.zeros((m, m))]])
    right = np.concatenate([np.zeros(n), totals])
    x = np.linalg.lstsq(kkt, right, rcond=None)[0]
    for _ in range(2):  # refinement
        x = x + np.linalg.lstsq(kkt, right - kkt @ x, rcond=None)[0]
    return x[:n]


def benchmarked(quarterly: DataFrame, rule: str) -> DataFrame:
    """Monthly series (key, month, value) that add up to quarterly ones (key, period, value); one group per series."""

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        values = denton_cholette(pdf["value"].to_numpy(float), rule)
        months = [d for p in pd.to_datetime(pdf["period"]) for d in pd.date_range(p, periods=3, freq="MS")]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "month": [d.date() for d in months], "value": values})

    return quarterly.groupBy("key").applyInPandas(own, "key string, month date, value double")


def adf_statistic(x: np.ndarray, max_lags: int | None = None) -> tuple[float, int]:
    """Augmented Dickey-Fuller t statistic with a constant, and the number of lags that has the least AIC."""
    dx, best = np.diff(x), None
    top = int(np.ceil(12 * (len(x) / 100) ** 0.25)) if max_lags is None else max_lags
    top = max(0, min(top, len(x) // 2 - 3))
    for lags in range(top + 1):
        for start in (top,) if lags < top + 1 else ():
            y = dx[start:]
            design = np.column_stack([x[start:-1], np.ones(len(y)), *[dx[start - i : len(dx) - i] for i in range(1, lags + 1)]])
            beta, *_ = np.linalg.lstsq(design, y, rcond=None)
            rest = y - design @ beta
            aic = len(y) * np.log(rest @ rest / len(y)) + 2 * design.shape[1]
            if best is None or aic < best[0]:
                best = (aic, lags)
    lags = best[1] if best else 0
    y = dx[lags:]
    design = np.column_stack([x[lags:-1], np.ones(len(y)), *[dx[lags - i : len(dx) - i] for i in range(1, lags + 1)]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ beta
    s2 = rest @ rest / max(len(y) - design.shape[1], 1)
    se = np.sqrt(s2 * np.linalg.pinv(design.T @ design)[0, 0])
    return float(beta[0] / se) if se > 0 else 0.0, lags


#: Fixed value: the 5 % critical value of the test with a constant in large samples.
ADF_CRITICAL = -2.86


def stationarity(series: DataFrame, least: int = 24) -> DataFrame:
    """By key the test's statistic, lags, and whether a unit root is rejected at 5 %; one group per series."""

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("month")["value"].dropna().to_numpy(float)
        stat, lags = adf_statistic(x) if len(x) >= least and x.std() > 1e-12 else (None, 0)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [len(x)], "statistic": [stat], "lags": [lags], "stationary": [None if stat is None else stat < ADF_CRITICAL]})

    return series.groupBy("key").applyInPandas(own, "key string, n long, statistic double, lags long, stationary boolean")


def trailing_growth(series: DataFrame) -> DataFrame:
    """Growth over three months in percent a year; null for the first three, or where the base is 0."""
    return series.withColumn("value", F.when(_lag("value", 3) != 0, 100 * (F.pow(F.col("value") / _lag("value", 3), F.lit(4)) - 1)))


def level_from_yoy(growth: DataFrame, base: float = 100.0) -> DataFrame:
    """Quarterly level (key, period, value) from growth over the year in percent: the year before the first one is base, and each quarter compounds off its own of the year before."""
    w = Window.partitionBy("key", F.quarter("period")).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return growth.withColumn("value", F.lit(base) * F.exp(F.sum(F.log(1 + F.col("value") / 100)).over(w)))


def panel_slice(series: DataFrame, keys: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """The series of some keys between two dates, both included."""
    out = series.filter(F.col("key").isin(*keys))
    out = out.filter(F.col("month") >= F.lit(start).cast("date")) if start else out
    return out.filter(F.col("month") <= F.lit(end).cast("date")) if end else out


def aggregation_residual(monthly: DataFrame, quarterly: DataFrame, rule: str) -> DataFrame:
    """By key the greatest relative difference between benchmarked months, taken to quarters by rule, and the quarters, and whether it is within 1e-10."""
    how = {"avg": F.avg("value"), "sum": F.sum("value"), "eop": F.max_by("value", "month")}[rule]
    again = monthly.groupBy("key", period_of(F.col("month"), "QS").alias("period")).agg(how.alias("_v"))
    both = again.join(quarterly.select("key", "period", "value"), ["key", "period"])
    gap = F.max(F.abs(F.col("_v") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1e-12)))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("periods"), (gap <= 1e-10).alias("identity_holds"))


def to_monthly(series: DataFrame, frequency: str, rule: str = "avg") -> DataFrame:
    """A series of any frequency as months: daily ones (D) by rule, monthly ones as they are, quarterly ones (Q) benchmarked."""
    if frequency == "D":
        return down(series, rule, "MS").select("key", F.col("period").alias("month"), "value")
    return benchmarked(series.select("key", F.col("month").alias("period"), "value"), rule) if frequency == "Q" else series.select("key", "month", "value")


def decoded(candidates: DataFrame) -> DataFrame:
    """Candidate names key@transform@lag taken apart."""
    part = F.split("candidate", "@")
    return candidates.withColumns({"key": part[0], "transform": part[1], "lag": part[2].cast("int")})
