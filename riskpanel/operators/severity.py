"""Severity of defaults: candidate drivers and their ranking, bins, the fit, its diagnostics, backtest and sensitivity.

All is summed in Spark by driver, bin, slice or period; the driver gets these few sums and fitted coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, clamp, logit, period_of
from ..functions.special import normal_tail
from ..sources.panels import unpivoted
from . import estimate
from .ranks import quantiles, spearman

#: Least observed severities to fit on, to test on, of a bin, of a bucket of the ranking, and of a year that is shown.
LEAST_FIT, LEAST_TEST, LEAST_BIN, LEAST_BUCKET, LEAST_YEAR = 60, 20, 25, 30, 5


def observed(panel: DataFrame, severity: str = "lgd_realised", target: str = "default_flag") -> DataFrame:
    """Defaults whose severity is known, within [0, 1]."""
    return panel.filter((F.col(target) == 1) & F.col(severity).isNotNull()).withColumn(severity, clamp(F.col(severity), 0.0, 1.0))


def candidates(defaults: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """By column of all defaults: share of rows that have it, different values, and whether a severity model may use it.

    Numeric columns must fill half of the rows and have 3 values; others need 2 to 12 levels.
    """
    long = unpivoted(defaults.select(*[F.col(c).cast("string").alias(c) for c in (*numeric, *categorical)]), [*numeric, *categorical])
    g = long.groupBy("name").agg(F.round(F.count("value") / F.count(F.lit(1)), 8).alias("filled"), F.count_distinct("value").alias("levels"))
    is_numeric = F.col("name").isin(list(numeric))
    fits = F.when(is_numeric, (F.col("filled") >= 0.5) & (F.col("levels") >= 3)).otherwise(F.col("levels").between(2, 12))
    return g.select(F.col("name").alias("column_name"), F.when(is_numeric, "numeric").otherwise("categorical").alias("kind"), "filled", "levels", fits.alias("offered"))


def ranking(seen: DataFrame, numeric: Sequence[str], categorical: Sequence[str], severity: str = "lgd_realised", buckets: int = 12, top: int = 20) -> DataFrame:
    """Drivers by |rank correlation| with severity, then by spread: the greatest less the least mean of their buckets or levels.

    Buckets are quantile ones of LEAST_BUCKET rows; of levels, the most frequent ones count. Levels have no rank correlation.
    """
    long = unpivoted(seen.select(severity, *[F.col(c).cast("double").alias(c) for c in numeric]), list(numeric), severity).filter("value IS NOT NULL")
    edges = quantiles(long, "value", [i / buckets for i in range(1, buckets)], ["name"], to="e").select("name", F.array_distinct("e").alias("e"))
    cells = long.join(F.broadcast(edges), "name").groupBy("name", bin_index(F.col("value"), F.col("e")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(severity).alias("m"))
    curves = cells.filter(F.col("n") >= LEAST_BUCKET).groupBy("name").agg((F.max("m") - F.min("m")).alias("spread"), F.count(F.lit(1)).alias("buckets"))
    own = spearman(long, "value", severity, ["name"]).select("name", F.col("rho").alias("spearman")).join(curves, "name")
    levels = unpivoted(seen.select(severity, *[F.col(c).cast("string").alias(c) for c in categorical]), list(categorical), severity) if categorical else None
    if levels is not None:
        by = levels.groupBy("name", F.coalesce("value", F.lit("Missing")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(severity).alias("m"))
        best = by.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "level", "m"))), 1, top).alias("a"))
        m = F.transform("a", lambda x: x["m"])
        own = own.unionByName(best.select("name", F.lit(None).cast("double").alias("spearman"), (F.array_max(m) - F.array_min(m)).alias("spread"), F.size("a").cast("long").alias("buckets")))
    shown = own.select(F.col("name").alias("column_name"), F.round("spearman", 7).alias("spearman"), F.round("spread", 8).alias("spread"), "buckets")
    return shown.orderBy(F.desc(F.abs(F.coalesce("spearman", F.lit(0.0)))), F.desc("spread"), "column_name")


def quasi_likelihood(share: Column, n: Column, mean: Column) -> Column:
    """Bernoulli quasi log likelihood of n rows of total severity share under one mean."""
    m = clamp(mean, 1e-9, 1 - 1e-9)
    return share * F.log(m) + (n - share) * F.log(1 - m)


def merged(counts: Sequence[int], least: int = LEAST_BIN) -> list[int]:
    """The new bin of each bin, from left to right: a bin is closed once it has enough rows, and a thin last one joins the one before."""
    place, held, sizes = [], 0, [0]
    for n in counts:
        if held >= least:
            sizes.append(0)
            held = 0
        place.append(len(sizes) - 1)
        held += n
        sizes[-1] += n
    if len(sizes) > 1 and sizes[-1] < least:
        place = [min(p, len(sizes) - 2) for p in place]
    return place


def bins(seen: DataFrame, columns: Sequence[str], severity: str = "lgd_realised", most: int = 5, least: int = LEAST_BIN) -> DataFrame:
    """By driver and quantile bin of enough rows: lower edge, n, share, mean severity, its standard error, the shift of its
    logit from the book's, and the driver's deviance R2.

    Cells are summed in Spark; merging thin ones is a scan of at most `most` counts a driver.
    """
    long = unpivoted(seen.select(severity, *[F.col(c).cast("double").alias(c) for c in columns]), list(columns), severity).filter("value IS NOT NULL")
    edges = quantiles(long, "value", [i / most for i in range(1, most)], ["name"], to="e").select("name", F.array_distinct("e").alias("e")).persist()
    s = F.col(severity)
    cells = long.join(F.broadcast(edges), "name").groupBy("name", bin_index(F.col("value"), F.col("e")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("s2"))
    found, cuts = cells.orderBy("name", "bin").collect(), {r.name: r.e for r in edges.collect()}  # most bins a driver
    edges.unpersist()
    place = []
    for name in dict.fromkeys(r.name for r in found):
        own = [r for r in found if r.name == name]
        to = merged([r.n for r in own], least)
        place += [(name, r.bin, k, float(cuts[name][r.bin - 1]) if r.bin else None) for r, k in zip(own, to, strict=True)]
    spark = seen.sparkSession
    own = spark.createDataFrame(found, "name string, bin int, n long, s double, s2 double").join(F.broadcast(spark.createDataFrame(place, "name string, bin int, to int, lo double")), ["name", "bin"])
    g = own.groupBy("name", F.col("to").alias("bin")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.min_by("lo", "bin").alias("lo"))
    whole = g.groupBy("name").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum(quasi_likelihood(F.col("s"), F.col("n"), F.col("s") / F.col("n"))).alias("ll"))
    n, mean, book = F.col("n"), F.col("s") / F.col("n"), F.col("ts") / F.col("tn")
    se = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s") * mean) / (n - 1)) / n)).otherwise(0.0)
    null = quasi_likelihood(F.col("ts"), F.col("tn"), book)
    r = lambda c, d: F.round(c, d)
    return g.join(whole, "name").select(F.col("name").alias("column_name"), "bin", "lo", "n", r(n / F.col("tn"), 8).alias("share"), r(mean, 8).alias("mean"), r(se, 8).alias("se"),
                                        r(logit(mean) - logit(book), 7).alias("weight"), r(1 - F.col("ll") / null, 7).alias("deviance_r2"))


def assumed(value: float) -> estimate.Model:
    """A declared flat severity as a model of the intercept alone; it holds under every scenario."""
    if not 0 < value < 1:
        raise ValueError(f"an assumed severity lies between 0 and 1, not at {value}")
    return estimate.Model(["(intercept)"], [math.log(value / (1 - value))], [0.0], 0.0, 0, [])


def fit(panel: DataFrame, treatments: dict[str, str], severity: str = "lgd_realised", target: str = "default_flag") -> estimate.Model:
    """A fractional-logit fit of observed severities with robust standard errors; fewer than LEAST_FIT are refused.

    Drivers that the panel lacks are left out.
    """
    seen = observed(panel, severity, target)
    n = seen.count()
    if n < LEAST_FIT:
        raise ValueError(f"{n} observed severities, and a fit needs {LEAST_FIT}: declare an assumed severity")
    return estimate.fit_logistic(seen, severity, {c: how for c, how in treatments.items() if c in panel.columns}, robust=True)


def scored(seen: DataFrame, model: estimate.Model, *keep: str, severity: str = "lgd_realised") -> DataFrame:
    """keep, actual and predicted severity. A driver that a model needs and the rows lack is an error."""
    gone = [t.column for t in model.terms if t.column not in seen.columns]
    if gone:
        raise ValueError(f"the severity model needs {', '.join(gone)}")
    return seen.select(*keep, F.col(severity).alias("actual"), model.score().alias("predicted"))


def measures(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of actual and predicted severity by group: n, means, MAE, RMSE, deviance R2 against the group's mean, rank correlation."""
    a, p = F.col("actual"), F.col("predicted")
    q = clamp(p, 1e-9, 1 - 1e-9)
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("_s"), F.avg(a).alias("_a"), F.avg(p).alias("_p"), F.avg(F.abs(a - p)).alias("_m"), F.sqrt(F.avg((a - p) * (a - p))).alias("_r"),
        F.sum(a * F.log(q) + (1 - a) * F.log(1 - q)).alias("_ll"),
    )
    ranked = spearman(rows.withColumn("predicted", F.round(p, 12)), "predicted", "actual", by).drop("n")
    g = g.join(ranked, list(by), "left") if by else g.crossJoin(F.broadcast(ranked))  # one row on either side
    r2 = 1 - F.col("_ll") / quasi_likelihood(F.col("_s"), F.col("n"), F.col("_a"))
    r = lambda c, name, d=8: F.round(c, d).alias(name)
    return g.select(*by, "n", r("_a", "mean_actual"), r("_p", "mean_predicted"), r("_m", "mae"), r("_r", "rmse"), r(F.when(F.col("n") > 1, r2), "deviance_r2", 7), r("rho", "spearman", 7))


def calibration(rows: DataFrame, cohorts: int = 10) -> DataFrame:
    """By quantile cohort of the prediction: n, both means, a 95 % band of the actual one, shares of no and of total loss."""
    own = rows.withColumn("predicted", F.round("predicted", 12))
    edges = quantiles(own, "predicted", [i / cohorts for i in range(1, cohorts)], to="e").select(F.array_distinct("e").alias("e"))
    at = bin_index(F.col("predicted"), F.col("e"))
    a, g = F.col("actual"), own.crossJoin(F.broadcast(edges)).groupBy((at + 1).alias("cohort"))  # one row of edges
    t = g.agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("p"), F.avg(a).alias("a"), F.stddev_samp(a).alias("d"), F.avg((a <= 1e-9).cast("int")).alias("z"), F.avg((a >= 1 - 1e-9).cast("int")).alias("t"))
    half = 1.96 * F.when(F.col("n") > 1, F.col("d") / F.sqrt("n")).otherwise(0.0)
    r = lambda c, name: F.round(c, 8).alias(name)
    return t.select("cohort", "n", r("p", "predicted"), r("a", "actual"), r(F.greatest(F.lit(0.0), F.col("a") - half), "low"), r(F.least(F.lit(1.0), F.col("a") + half), "high"), r("z", "zero_share"), r("t", "total_share"))


def residual_curve(rows: DataFrame, groups: int | None = None) -> DataFrame:
    """Mean Pearson residual by quantile group of the prediction, with a 95 % band; if not given, a group for each 20 rows, 3 at least and 20 at most."""
    groups = groups or min(20, max(3, rows.count() // 20))
    own = rows.withColumn("predicted", F.round("predicted", 12))
    edges = quantiles(own, "predicted", [i / groups for i in range(1, groups)], to="e").select(F.array_distinct("e").alias("e"))
    residual = (F.col("actual") - F.col("predicted")) / F.sqrt(F.greatest(F.lit(1e-6), F.col("predicted") * (1 - F.col("predicted"))))
    g = own.crossJoin(F.broadcast(edges)).groupBy(bin_index(F.col("predicted"), F.col("e")).alias("bin"))  # one row of edges
    t = g.agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("p"), F.avg(residual).alias("r"), F.stddev_samp(residual).alias("d"))
    half = F.coalesce(1.96 * F.col("d") / F.sqrt("n"), F.lit(0.0))
    r = lambda c, name: F.round(c, 7).alias(name)
    return t.select("bin", "n", r("p", "predicted"), r("r", "residual"), r(F.col("r") - half, "low"), r(F.col("r") + half, "high"))


def link_test(rows: DataFrame) -> tuple[float, float | None, float | None]:
    """Coefficient, z and p of the squared linear predictor in a refit on it and its square: a small p speaks against the link."""
    eta = logit(F.col("predicted"), 1e-13)
    own = rows.select(F.lit(1.0).alias("x0"), eta.alias("x1"), (eta * eta).alias("x2"), F.col("actual").alias("y")).persist()
    beta, h, _, _ = estimate.newton(own, 3, rate=own.agg(F.avg("y")).first()[0])
    inverse = np.linalg.pinv(h)
    inverse = inverse @ estimate.sums(own, beta, meat=True)[4] @ inverse
    own.unpersist()
    se = math.sqrt(max(inverse[2, 2], 0.0))
    z = float(beta[2]) / se if se > 1e-12 else None
    return float(beta[2]), z, None if z is None else normal_tail(z)


def by_year(rows: DataFrame, boundary: str, freq: str = "YS", least: int = LEAST_YEAR) -> DataFrame:
    """Actual and predicted means by year (or other period) of enough rows, and whether it lies before the boundary."""
    g = rows.groupBy(period_of(F.col("performance_date"), freq).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("actual").alias("a"), F.avg("predicted").alias("p"), F.stddev_samp("actual").alias("d"))
    half = F.coalesce(1.96 * F.col("d") / F.sqrt("n"), F.lit(0.0))
    r = lambda c, name: F.round(c, 8).alias(name)
    return g.filter(F.col("n") >= least).select("period", "n", r("a", "actual"), r("p", "predicted"), r(F.col("a") - half, "low"), r(F.col("a") + half, "high"), (F.col("period") < F.lit(boundary).cast("date")).alias("in_sample"))


def backtest(panel: DataFrame, treatments: dict[str, str], boundary: str, severity: str = "lgd_realised", target: str = "default_flag") -> DataFrame:
    """measures by slice (train, test) of a model fitted before the boundary; no row where there are too few to fit or to test on."""
    late = F.col("performance_date") >= F.lit(boundary).cast("date")
    seen = observed(panel, severity, target).withColumn("slice", F.when(late, "test").otherwise("train"))
    n = {r["slice"]: r["count"] for r in seen.groupBy("slice").count().collect()}  # two slices
    if n.get("train", 0) < LEAST_FIT or n.get("test", 0) < LEAST_TEST:
        return measures(seen.filter("false").select("slice", F.col(severity).alias("actual"), F.col(severity).alias("predicted")), ["slice"])
    model = fit(seen.filter("slice = 'train'"), treatments, severity, target)
    return measures(scored(seen, model, "slice", severity=severity), ["slice"])


def sensitivity(seen: DataFrame, model: estimate.Model, drivers: Sequence[str]) -> DataFrame:
    """By driver: its standard deviation, and the mean predicted severity as it is and with the driver one deviation up and down."""
    sd = seen.agg(*[F.stddev_samp(F.col(c)).alias(c) for c in drivers]).first()
    moved = {c: sd[c] for c in drivers if sd[c]}
    out = None
    for sign, label in ((0.0, "base"), (1.0, "up"), (-1.0, "down")):
        for c, d in moved.items():
            own = seen.withColumn(c, F.col(c) + sign * d).agg(F.round(F.avg(model.score()), 8).alias("value")).select(F.lit(c).alias("driver"), F.lit(d).alias("sd"), F.lit(label).alias("move"), "value")
            out = own if out is None else out.unionByName(own)
    if out is None:
        return seen.sparkSession.createDataFrame([], "driver string, sd double, base double, up double, down double")
    pick = lambda m: F.max(F.when(F.col("move") == m, F.col("value"))).alias(m)
    return out.groupBy("driver", "sd").agg(pick("base"), pick("up"), pick("down")).withColumn("sd", F.round("sd", 6))
