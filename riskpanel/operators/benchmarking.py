"""Quarterly series on the monthly grid: proportional benchmarking with an indicator, and growth by way of its level.

Growth is never interpolated: it becomes a level, the level is benchmarked so that each quarter's last month has the
published value, and growth is taken of that. With end-of-period constraints the smoothest ratio to the indicator runs
straight from quarter to quarter, so this case is windows in Spark; averages and sums are solved for each series in a task, with
its indicator beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_index, period_of
from .macro import aggregation_matrix, growth_from_level, level_from_growth

#: Months of a quarter, and the least size of an indicator, which is divided by.
EACH, LEAST = 3, 1e-12


def away_from_zero(z: Column) -> Column:
    return F.when(F.abs(z) < LEAST, F.lit(LEAST)).otherwise(z)


def months_of(quarterly: DataFrame) -> DataFrame:
    """key and month: all months from the first quarter's first to the last quarter's last."""
    ends = quarterly.groupBy("key").agg(F.min("period").alias("a"), F.add_months(F.max("period"), EACH - 1).alias("b"))
    return ends.select("key", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


def straight(rows: DataFrame, value: str, to: str) -> DataFrame:
    """Nulls of value (by key and month) on the straight line between the values around them; before the first and after the last one as these."""
    before = Window.partitionBy("key").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key").orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(month_index(F.col("month")).alias("at"), F.col(value).cast("double").alias("x")))
    out = rows.withColumns({"_a": F.last(known, True).over(before), "_b": F.first(known, True).over(after)})
    a, b = F.col("_a"), F.col("_b")
    part = (month_index(F.col("month")) - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
    return out.withColumn(to, F.coalesce(a["x"] + (b["x"] - a["x"]) * F.coalesce(part, F.lit(0.0)), a["x"], b["x"])).drop("_a", "_b")


def on_months(quarterly: DataFrame, indicator: DataFrame | None) -> DataFrame:
    """key, month and z: the indicator on the quarterly series' months, gaps filled straight; 1 where a key has none."""
    grid = months_of(quarterly)
    if indicator is None:
        return grid.withColumn("z", F.lit(1.0))
    filled = straight(grid.join(indicator.select("key", "month", F.col("value").cast("double").alias("_z")), ["key", "month"], "left"), "_z", "z")
    return filled.select("key", "month", F.coalesce(away_from_zero(F.col("z")), F.lit(1.0)).alias("z"))


def end_of_quarter(quarterly: DataFrame, indicator: DataFrame | None = None) -> DataFrame:
    """Monthly levels (key, month, value) whose last month of each quarter is the quarterly value (key, period, value)."""
    ends = quarterly.select("key", F.add_months("period", EACH - 1).alias("month"), F.col("value").alias("_v"))
    rows = on_months(quarterly, indicator).join(ends, ["key", "month"], "left").withColumn("_u", F.col("_v") / F.col("z"))
    return straight(rows, "_u", "_r").select("key", "month", (F.col("_r") * F.col("z")).alias("value"))


def growth_by_level(growth: DataFrame, indicator: DataFrame | None = None, base: float = 100.0) -> DataFrame:
    """Monthly annualised growth in percent (key, month, level, value) from quarterly annualised growth (key, period, value).

    The level begins at base before the first month.
    """
    level = level_from_growth(growth.withColumnRenamed("period", "month"), 4, base).select("key", F.col("month").alias("period"), "value")
    monthly = end_of_quarter(level, indicator)
    start = monthly.groupBy("key").agg(F.add_months(F.min("month"), -1).alias("month")).withColumn("value", F.lit(base))
    grown = growth_from_level(monthly.unionByName(start), 12).filter("value IS NOT NULL")
    return grown.join(monthly.withColumnRenamed("value", "level"), ["key", "month"]).select("key", "month", "level", "value")


def proportional(totals: np.ndarray, rule: str, indicator: np.ndarray | None = None, offset: int = 0, months: int | None = None) -> np.ndarray:
    """Monthly values that meet the quarterly totals exactly and whose ratio to the indicator changes least, in squares, from month to month.

    offset: months before the first quarter. months: all months; those after the last quarter are free, too.
    """
    m = len(totals)
    n = offset + EACH * m if months is None else months
    if n < offset + EACH * m:
        raise ValueError(f"{n} months for {m} quarters from month {offset} on")
    z = np.ones(n) if indicator is None else np.where(np.abs(indicator) < LEAST, LEAST, indicator).astype(float)
    if len(z) != n:
        raise ValueError(f"an indicator of {len(z)} months for {n}")
    c = np.zeros((m, n))
    c[:, offset : offset + EACH * m] = aggregation_matrix(m, EACH, rule)
    size, level = np.abs(z).mean(), float(np.abs(totals).mean()) or 1.0
    # In ratios the objective is a path's: 2 on the diagonal, 1 at both ends, -1 beside it.
    path = np.diag([1.0, *[2.0] * (n - 2), 1.0]) - np.eye(n, k=1) - np.eye(n, k=-1) if n > 1 else np.zeros((1, 1))
    a = c * (z / size)[None, :]
    system = np.block([[path, a.T], [a, np.zeros((m, m))]])
    right = np.concatenate([np.zeros(n), np.asarray(totals, float) / level])
    u = np.linalg.solve(system, right)
    u += np.linalg.solve(system, right - system @ u)
    return u[:n] * z / size * level


def benchmarked(quarterly: DataFrame, indicator: DataFrame | None = None) -> DataFrame:
    """Monthly series (key, month, value) of quarterly ones (key, period, value, agg: avg, sum or eop), each in a task with its indicator."""

    def own(q: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"key": [], "month": [], "value": []})
        q, z = q.sort_values("period"), z.sort_values("month")
        values = proportional(q["value"].to_numpy(float), q["agg"].iloc[0], z["z"].to_numpy(float))
        return pd.DataFrame({"key": q["key"].iloc[0], "month": z["month"].to_numpy(), "value": values})

    grid = on_months(quarterly, indicator).select(F.col("key").alias("_key"), "month", "z")
    return quarterly.groupBy("key").cogroup(grid.groupBy("_key")).applyInPandas(own, "key string, month date, value double")


def quarters_again(monthly: DataFrame) -> DataFrame:
    """key, period, avg, sum and eop of monthly values: what a benchmarked series must give back."""
    return monthly.groupBy("key", period_of(F.col("month"), "QS").alias("period")).agg(F.avg("value").alias("avg"), F.sum("value").alias("sum"), F.max_by("value", "month").alias("eop"))
