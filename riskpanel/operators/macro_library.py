"""The library of macro candidates in full: each term at each lag with its unit-root test, its correlation with default log odds and with single severities, and both signs against the expected one.

A candidate is judged over the estimation window only, from the first to the last month that has log odds. All
candidates are rows of one long table: the correlations are aggregates by candidate, and only the test of a unit root is a group
of Python, of a series' months.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import student_tail
from .macro import adf_statistic, candidate_correlations
from .macro_severity import rank_correlations

#: Months that a candidate needs within the window, and the level of the unit-root test.
LEAST_MONTHS, ALPHA = 24, 0.05
#: Published response surface of the test with a constant; p is the normal distribution function of a
#: polynomial of the statistic, of the first row up to the break and of the second one above it.
SURFACE = [[2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]]
LOWEST, BREAK, HIGHEST = -18.83, -1.61, 2.74


def unit_root_p(statistic: float) -> float:
    """Approximate p-value of an augmented Dickey-Fuller statistic with a constant."""
    if statistic <= LOWEST or statistic >= HIGHEST:
        return 0.0 if statistic <= LOWEST else 1.0
    row = SURFACE[0] if statistic <= BREAK else SURFACE[1]
    z = sum(c * statistic**i for i, c in enumerate(row))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def estimation_window(log_odds: DataFrame) -> DataFrame:
    """One row: first_month and last_month of the target, and its months."""
    return log_odds.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("months"))


def windowed(candidates: DataFrame, log_odds: DataFrame, least: int = LEAST_MONTHS) -> DataFrame:
    """Finite values within the estimation window, of the candidates that have so many of them."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    ends = estimation_window(log_odds)  # one row
    seen = candidates.filter(finite).join(F.broadcast(ends)).filter(F.col("month").between(F.col("first_month"), F.col("last_month")))
    seen = seen.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("candidate")))
    return seen.filter(F.col("_n") >= least).drop("_n", *ends.columns)


def unit_roots(candidates: DataFrame, least: int = LEAST_MONTHS, alpha: float = ALPHA) -> DataFrame:
    """By candidate (candidate, month, value) the statistic, the lags of least AIC, p, and whether a unit root is rejected; null for short or constant series."""

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("month")["value"].to_numpy(float)
        x = x[np.isfinite(x)]
        stat, lags = adf_statistic(x) if len(x) >= least and x.std() > 1e-12 else (None, None)
        p = None if stat is None else unit_root_p(stat)
        return pd.DataFrame({"candidate": [pdf["candidate"].iloc[0]], "adf": [stat], "adf_lags": pd.array([lags], "Int64"), "adf_p": [p], "stationary": pd.array([None if p is None else p < alpha], "boolean")})

    return candidates.select("candidate", "month", "value").groupBy("candidate").applyInPandas(own, "candidate string, adf double, adf_lags long, adf_p double, stationary boolean")


def expected_sign(key: Column, priors: Mapping[str, int]) -> Column:
    """The prior of a series by its own name, by that of its growth, or, for growth over the year, by that of its level."""
    if not priors:
        return F.lit(None).cast("int")
    signs = F.create_map(*[F.lit(x) for pair in sorted(priors.items()) for x in pair])
    level = F.when(key.endswith("_yoy"), F.try_element_at(signs, F.regexp_replace(key, "_yoy$", "")))
    return F.coalesce(F.try_element_at(signs, key), *[F.try_element_at(signs, F.concat(key, F.lit(s))) for s in ("_yoy", "_growth")], level)


def library(candidates: DataFrame, log_odds: DataFrame, counts: DataFrame, priors: Mapping[str, int], least: int = LEAST_MONTHS) -> DataFrame:
    """A row for each candidate (candidate, key, transform, lag, month, value) with enough months: default_ and severity_ n, n_effective, r, p, sign and sign_ok, and expected_sign.

    r and p are null where a side has too few rows or is constant; a sign is null without r, sign_ok also without a prior.
    """
    seen = windowed(candidates, log_odds, least)
    each = seen.groupBy("candidate", "key", "transform", "lag").agg(F.count(F.lit(1)).alias("months")).withColumn("expected_sign", expected_sign(F.col("key"), priors))
    rates = candidate_correlations(seen, log_odds, least)
    free = (F.col("n_effective") > 2) & (F.abs("r") < 1)
    t = F.when(free, F.col("r") * F.sqrt((F.col("n_effective") - 2) / (1 - F.col("r") * F.col("r"))))
    rates = rates.withColumn("p", student_tail(t, F.col("n_effective") - 2))
    out = each
    for side, found in (("default", rates), ("severity", rank_correlations(seen, counts))):
        names = {c: f"{side}_{c}" for c in ("n", "n_effective", "r", "p")}
        out = out.join(found.select("candidate", *[F.col(c).alias(to) for c, to in names.items()]), "candidate", "left")
        r = F.col(f"{side}_r")
        out = out.withColumn(f"{side}_sign", F.when(r > 0, 1).when(r.isNotNull(), -1))
        out = out.withColumn(f"{side}_sign_ok", F.col(f"{side}_sign") == F.col("expected_sign"))
    return out
