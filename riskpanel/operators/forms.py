"""How a driver should enter a model: the shape of its bins, and a straight against a bent form by the model's own estimator, for defaults and for severity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, sigmoid
from ..functions.special import chi2_tail
from ..sources.panels import unpivoted
from . import binning, curves, estimate
from .knots import search

#: R2 of a straight line that makes a column linear, of a curve that follows a reversal, and the gain that makes a bend.
STRAIGHT, FOLLOWS, BENDS = 0.95, 0.75, 0.03


def shapes(df: DataFrame, columns: Sequence[str], target: str, bins: int = 8) -> DataFrame:
    """By numeric column: R2 of weighted polynomials of degree 1 to 3 through the bins' weights of evidence, the curvature
    (what a bend adds to a line), whether the rates are monotone, and the treatment that the shape asks for.

    Bins without rows and missing ones are left out; under 4 bins the answer is woe. A bin stands at the middle of its
    edges, an open one at its edge. Each degree's R2 comes from the part of that power which the lower ones don't hold.
    """
    cells = binning.value_cells(unpivoted(df, list(columns), target), target)
    edges = binning.quantile_edges(cells, bins, "n")
    woe = binning.woe_table(binning.bin_counts(cells, edges, "e", "n")).filter("bin >= 0 AND n > 0")
    e, i = F.col("edges"), F.col("bin")
    at = F.when(F.size("edges") == 0, F.lit(0.0)).when(i == 0, F.element_at("edges", 1)).when(i == F.size("edges"), F.element_at("edges", -1)).otherwise((F.get(e, i - 1) + F.get(e, i)) / 2)
    own = Window.partitionBy("name")
    rows = woe.join(F.broadcast(edges), "name").select("name", "bin", "n", "rate", F.col("woe").alias("y"), at.alias("x"))
    rows = rows.withColumns({"w": F.col("n") / F.sum("n").over(own), "x": (F.col("x") - F.avg("x").over(own)) / F.coalesce(F.nullif(F.stddev_pop("x").over(own), F.lit(0.0)), F.lit(1.0)), "step": F.col("rate") - F.lag("rate").over(own.orderBy("bin"))})

    def dot(a: Column, b: Column) -> Column:
        return F.sum(F.col("w") * a * b).over(own)

    x, y = F.col("x"), F.col("y")
    rows = rows.withColumn("z0", F.lit(1.0)).withColumn("y", y - F.sum(F.col("w") * y).over(own))
    for d in (1, 2, 3):
        part = F.pow(x, F.lit(d))
        rest = part - sum((dot(part, F.col(f"z{j}")) / F.nullif(dot(F.col(f"z{j}"), F.col(f"z{j}")), F.lit(0.0)) * F.col(f"z{j}") for j in range(d)), F.lit(0.0))
        rows = rows.withColumn(f"z{d}", rest)
    gain = lambda d: F.pow(F.sum(F.col("w") * F.col(f"z{d}") * y), 2) / F.nullif(F.sum(F.col("w") * F.pow(f"z{d}", F.lit(2))) * F.sum(F.col("w") * y * y), F.lit(0.0))
    g = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("bins"), (F.max("y") - F.min("y")).alias("range"), (F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True))).alias("monotone"),
        *[F.coalesce(gain(d), F.lit(0.0)).alias(f"g{d}") for d in (1, 2, 3)],
    )
    smooth = F.col("g1") + F.col("g2") + F.when(F.col("bins") >= 5, F.col("g3")).otherwise(0.0)
    few, flat = F.col("bins") < 4, F.col("range") < 1e-8
    want = (
        F.when(few, "woe").when(flat, "continuous").when(~F.col("monotone"), F.when(smooth >= FOLLOWS, "spline").otherwise("bins"))
        .when(F.col("g1") >= STRAIGHT, "continuous").when(F.col("g2") >= BENDS, "spline").otherwise("woe")
    )
    sure = F.when(few | flat, "low").when(want == "woe", "medium").otherwise("high")
    r = lambda c, name: F.round(F.when(~few, F.when(flat, 0.0).otherwise(c)), 6).alias(name)
    return g.select(F.col("name").alias("column_name"), "bins", "monotone", r(F.col("g1"), "linear_r2"), r(smooth, "smooth_r2"), r(F.col("g2"), "curvature"), want.alias("treatment"), sure.alias("confidence"))


def compared(df: DataFrame, column: str, target: str, knots: Sequence[float]) -> dict:
    """A straight and a bent logistic form of one column on the same rows: likelihoods, pseudo R2, BIC on events and the likelihood ratio.

    Knots outside of the column's range are left out; without any, bent is None.
    """
    rows = df.select(F.col(column).cast("double").alias("v"), F.col(target).cast("double").alias("y")).dropna().persist()
    s = rows.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("y").alias("rate"), F.sum("y").alias("e"), F.count(F.lit(1)).alias("n")).first()
    if not s.n or not 0 < s.rate < 1:
        rows.unpersist()
        raise ValueError("a form needs rows with and without the event")
    null, cost = s.n * (s.rate * math.log(s.rate) + (1 - s.rate) * math.log(1 - s.rate)), math.log(max(s.e, 2))

    def form(inside: Sequence[float]) -> dict:
        x = [F.lit(1.0), (F.col("v") - s.m) / (s.d or 1.0), *[F.greatest(F.col("v") - k, F.lit(0.0)) / (s.d or 1.0) for k in inside]]
        k = len(x)
        ll = estimate.newton(rows.select("y", *[c.alias(f"x{i}") for i, c in enumerate(x)]), k, rate=s.rate)[2]
        return {"parameters": k, "log_likelihood": ll, "pseudo_r2": 1 - ll / null, "bic": k * cost - 2 * ll}

    inside = [k for k in knots if s.lo < k < s.hi]
    straight, bent = form([]), form(inside) if inside else None
    rows.unpersist()
    if bent:
        lr, more = max(0.0, 2 * (bent["log_likelihood"] - straight["log_likelihood"])), bent["parameters"] - straight["parameters"]
        bent |= {"lr": lr, "lr_p": chi2_tail(lr, more), "delta_bic": bent["bic"] - straight["bic"]}
    return {"straight": straight, "bent": bent}


def quasi_statistics(rows: DataFrame, beta: Sequence[float], tested: Sequence[int] = ()) -> dict:
    """Of a fractional logit (cells x0 and so on, y) at some coefficients: parameters, n, quasi-likelihood, dispersion (Pearson's
    statistic by its degrees of freedom), and the Wald statistic of the tested coefficients with the sandwich's covariance.

    A quasi-likelihood is none, so a likelihood ratio has no chi-squared; the robust Wald statistic has.
    """
    beta = np.asarray(beta, float)
    k = len(beta)
    h, _, ll, n, meat = estimate.sums(rows, beta, meat=True)
    mu = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), sigmoid(sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)), 30.0)))
    pearson = rows.agg(F.sum(F.pow(F.col("y") - mu, F.lit(2)) / (mu * (1 - mu)))).first()[0] or 0.0
    out = {"parameters": k, "n": n, "log_likelihood": ll, "dispersion": max(pearson / max(n - k, 1), 1e-9), "wald": None, "wald_p": None}
    if len(tested):
        inverse = np.linalg.pinv(h)
        own = np.ix_(tested, tested)
        wald = float(beta[list(tested)] @ np.linalg.pinv((inverse @ meat @ inverse)[own]) @ beta[list(tested)])
        out |= {"wald": wald, "wald_p": chi2_tail(max(wald, 0.0), len(tested))}
    return out


def scaled_bic(stats: dict, dispersion: float) -> float:
    """BIC of a quasi-likelihood, by a dispersion that all compared forms share: else the larger form would be paid for the noise it fits."""
    return -2 * stats["log_likelihood"] / dispersion + stats["parameters"] * math.log(max(stats["n"], 2))


def severity_cells(df: DataFrame, column: str, severity: str, center: float, scale: float, knots: Sequence[float]) -> DataFrame:
    """Cells of a severity form: 1, the scaled value, and a hinge at each knot."""
    v = F.col(column).cast("double")
    x = [F.lit(1.0), (v - center) / scale, *[F.greatest(v - k, F.lit(0.0)) / scale for k in knots]]
    rows = df.filter(v.isNotNull() & F.col(severity).isNotNull())
    return rows.select(clamp(F.col(severity).cast("double"), 0.0, 1.0).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])


def severity_forms(df: DataFrame, column: str, severity: str, knots: Sequence[float] | None = None) -> dict:
    """A straight and a bent form of a severity driver by the severity model's own estimator: deviance R2, dispersion, scaled BIC and the robust test of the bends.

    Knots are searched for if not given; those outside of the column's range are left out, and without any bent is None.
    """
    v = F.col(column).cast("double")
    s = df.filter(F.col(severity).isNotNull()).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("d"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    knots = search(df, column, severity, 3, 40, severity=True).knots if knots is None else knots
    inside = [float(k) for k in knots if s.lo < k < s.hi]
    rows = severity_cells(df, column, severity, s.m, s.d or 1.0, inside).persist()
    rate = rows.agg(F.avg("y")).first()[0]
    fits = estimate.newton_many(rows, {"straight": [0, 1], "bent": list(range(2 + len(inside)))}, rate=rate)
    null = fits["straight"][3] * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate)) if 0 < rate < 1 else 0.0
    straight = quasi_statistics(rows.select("y", "x0", "x1"), fits["straight"][0])
    bent = quasi_statistics(rows, fits["bent"][0], range(2, 2 + len(inside))) if inside else None
    rows.unpersist()
    shared = (bent or straight)["dispersion"]
    for form in (straight, bent):
        if form:
            form |= {"deviance_r2": 1 - form["log_likelihood"] / null if null else 0.0, "bic": scaled_bic(form, shared)}
    if bent:
        bent |= {"knots": inside, "delta_bic": bent["bic"] - straight["bic"]}
    return {"straight": straight, "bent": bent}


def recommended(forms: dict, reversals: int) -> str:
    """continuous where a bend doesn't pay by BIC; bins where it does but the curve turns twice or more; else spline."""
    if not forms["bent"] or forms["bent"]["delta_bic"] >= 0:
        return "continuous"
    return "bins" if reversals >= 2 else "spline"


def recommendation(df: DataFrame, column: str, target: str, knots: Sequence[float] | None = None) -> DataFrame:
    """One row: the treatment, both forms' BIC and pseudo R2, the test between them, the knots and the curve's turning points.

    Turning points are taken from the curve's buckets, 30 at most; a turn must exceed the mean half width of its interval.
    """
    points = [r for r in curves.log_odds_curve(df, column, target).collect() if 0 < r.events < r.n]  # 30 buckets
    points.sort(key=lambda r: r.bucket)
    if knots is None:
        knots = search(df, column, target).knots
    half = sum((r.high - r.low) / 2 for r in points) / max(len(points), 1)
    turns = curves.turning_points([r.smooth for r in points], half) if points else 0
    f = compared(df, column, target, knots)
    a, b = f["straight"], f["bent"] or {}
    six = lambda v: None if v is None else round(float(v), 6)
    row = (recommended(f, turns), [float(k) for k in knots], turns, six(a["pseudo_r2"]), six(b.get("pseudo_r2")), six(a["bic"]), six(b.get("bic")), six(b.get("lr_p")))
    return df.sparkSession.createDataFrame([row], "treatment string, knots array<double>, turns int, linear_r2 double, spline_r2 double, linear_bic double, spline_bic double, lr_p double")
