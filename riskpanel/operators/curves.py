"""Curves of the target against a column: bucket log-odds with intervals, turning points, knots; severity by bucket and level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, steady_mean
from .ranks import quantiles


def log_odds_curve(df: DataFrame, column: str, target: str, resolution: int = 30) -> DataFrame:
    """By quantile bucket: n, events, mean of the column, log odds (half an observation added) with a 95 % interval, and a smoothed one."""
    rows = df.select(F.col(column).cast("double").alias("value"), F.col(target).alias("y")).filter("value IS NOT NULL")
    edges = quantiles(rows, "value", [i / resolution for i in range(1, resolution)], to="e").select(F.array_distinct("e").alias("e"))
    g = rows.crossJoin(F.broadcast(edges)).groupBy(bin_index(F.col("value"), F.col("e")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), steady_mean(F.col("value")).alias("x"))
    e, o = F.col("events") + 0.5, F.col("n") - F.col("events") + 0.5
    lo = F.log(e / o)
    half = 1.959964 * F.sqrt(1 / e + 1 / o)
    smooth = F.avg(lo).over(Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(-1, 1))
    r = lambda c: F.round(c, 7)
    return g.select("bucket", "n", "events", r("x").alias("x"), r(lo).alias("log_odds"), r(lo - half).alias("low"), r(lo + half).alias("high"), r(smooth).alias("smooth"))


def categorical_curve(df: DataFrame, column: str, target: str, top: int = 25) -> DataFrame:
    """By level (the most frequent; others as one): n, events and log odds."""
    each = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("events"))
    best = each.orderBy(F.desc("n"), "level").limit(top).select("level", F.lit(True).alias("_in"))
    g = each.join(F.broadcast(best), "level", "left").groupBy(F.when(F.col("_in"), F.col("level")).otherwise("Other").alias("level")).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    return g.select("level", "n", "events", F.round(F.log((F.col("events") + 0.5) / (F.col("n") - F.col("events") + 0.5)), 7).alias("log_odds"))


def severity_curve(df: DataFrame, column: str, severity: str, buckets: int = 12, least: int = 30) -> DataFrame:
    """By quantile bucket with enough rows: n, mean of the column, mean severity and its standard error."""
    rows = df.select(F.col(column).cast("double").alias("value"), F.col(severity).alias("s")).filter("value IS NOT NULL AND s IS NOT NULL")
    edges = quantiles(rows, "value", [i / buckets for i in range(1, buckets)], to="e").select(F.array_distinct("e").alias("e"))
    g = rows.crossJoin(F.broadcast(edges)).groupBy(bin_index(F.col("value"), F.col("e")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), steady_mean(F.col("value")).alias("x"), F.avg("s").alias("m"), F.stddev_samp("s").alias("d")).filter(F.col("n") >= least)
    return g.select("bucket", "n", F.round("x", 7).alias("x"), F.round("m", 8).alias("mean"), F.round(F.col("d") / F.sqrt("n"), 8).alias("se"))


def severity_levels(df: DataFrame, column: str, severity: str, top: int = 20) -> DataFrame:
    """By level, the most frequent ones: n, mean severity and standard error."""
    g = df.filter(F.col(severity).isNotNull()).groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(severity).alias("m"), F.stddev_samp(severity).alias("d"))
    return g.orderBy(F.desc("n"), "level").limit(top).select("level", "n", F.round("m", 8).alias("mean"), F.round(F.col("d") / F.sqrt("n"), 8).alias("se"))


def severity_distribution(df: DataFrame, severity: str, bins: int = 20) -> DataFrame:
    """Rows by equal bins of (0, 1]; bin 0 holds those of no loss."""
    s = F.col(severity)
    at = F.when(s <= 0, 0).otherwise(F.least(F.lit(bins), F.floor(F.greatest(s, F.lit(0.0)) * bins) + 1)).cast("int")
    return df.filter(s.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 8).alias("mean"))


def turning_points(values: Sequence[float], threshold: float) -> int:
    """Reversals of a short series, of which each swing between them is more than the threshold.

    The series is reduced to its ends and local extremes; while its smallest swing is within the threshold, that
    swing goes: at an end with the end, elsewhere with both extremes, so that what is left still alternates.
    """
    v = np.asarray(values, float)
    steps = np.diff(v)
    moved = np.flatnonzero(steps)
    if not len(moved):
        return 0
    turns = moved[1:][np.sign(steps[moved[1:]]) != np.sign(steps[moved[:-1]])]
    marks = [v[0], *v[turns], v[-1]]
    while len(marks) > 1:
        swings = np.abs(np.diff(marks))
        i = int(np.argmin(swings))
        if swings[i] > threshold:
            break
        if i == 0:
            del marks[0]
        elif i == len(swings) - 1:
            del marks[-1]
        else:
            del marks[i : i + 2]
    return max(0, len(marks) - 2)
