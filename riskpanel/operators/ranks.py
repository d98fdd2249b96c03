"""Totals in order of a value, and exact quantiles, without sorting all rows in one task.

Rows are first summed by value. The values are split into ranges by approximate quantiles; each range starts from the
totals of the ranges below it, so a window never spans more than a range, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least and most ranges of values, between which there are as many as shuffle partitions; a group's marks are an array of so many values.
RANGES = (64, 1024)


def ranged(df: DataFrame, value: str, marks: str, to: str, n: int) -> DataFrame:
    """df with the number of marks (a sorted array of n - 1, n a power of two) at or below value: a search by halves, in compiled code."""
    out, step = df.withColumn(to, F.lit(0)), n // 2
    while step:
        at = F.col(marks)[F.col(to) + (step - 1)]
        out, step = out.withColumn(to, F.col(to) + F.when(F.col(value) >= at, step).otherwise(0)), step // 2
    return out


def running_totals(table: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), kept: bool = False) -> DataFrame:
    """table (one row per value, within by) with before_<s>, the total of s over smaller values, and all_<s>, over all.

    The marks are taken once, before the plan is made: approximate quantiles depend on the order in which blocks arrive, and
    totals and windows must agree about each value's range. kept: table is read from a table that is kept already.
    """
    keys = list(by) or ["_all"]
    own = table if kept else table.persist()
    own = own if by else own.withColumn("_all", F.lit(1))
    n = max(RANGES[0], min(RANGES[1], 1 << (int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    marks = own.groupBy(*keys).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 2 * RANGES[1]).alias("_marks"))
    marks = table.sparkSession.createDataFrame(marks.collect(), marks.schema)
    # Groups are columns, periods, segments or scenarios: few, with a short array each. A join by their keys would
    # bring all values of a group to one task.
    own = ranged(own.join(F.broadcast(marks), keys), value, "_marks", "_range", n).drop("_marks")
    totals = own.groupBy(*keys, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(s).over(below), F.lit(0)).alias(f"_start_{s}") for s in sums], *[F.sum(s).over(every).alias(f"all_{s}") for s in sums])
    inner = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = own.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_in_{s}") for s in sums]).join(starts, [*keys, "_range"])
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_start_{s}") + F.col(f"_in_{s}"))
    return out.drop("_range", "_all", *[f"_start_{s}" for s in sums], *[f"_in_{s}" for s in sums])


def between(lo: Column, hi: Column, part: Column) -> Column:
    """lo * (1 - part) + hi * part, the sum rounded once, as quantile_cont takes it: edges agree to the last bit, also among equal values."""
    whole = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), lo, 1 - part, hi * part).cast("double")
    return F.when(part > 0, whole).otherwise(lo)


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = (), to: str = "q", weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation as an array: one row per group of by. Nulls are left out.

    weight: a column of counts; then each value comes once in a group, as in a table that is kept for several uses.
    """
    present = df.filter(F.col(value).isNotNull())
    counted = present.select(*by, value, F.col(weight).alias("_n")) if weight else present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).persist()
    run = running_totals(counted, value, ["_n"], by, kept=True)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before__n") <= rank) & (rank < F.col("before__n") + F.col("_n")), F.col(value)))

    parts = []
    for i, f in enumerate(fractions):
        place = F.lit(float(f)) * (F.col("all__n") - 1)
        parts += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
    found = run.groupBy(*by).agg(*parts)
    each = [between(F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double"), F.col(f"_w{i}")) for i in range(len(fractions))]
    return found.select(*by, F.array(*each).alias(to))


def many_quantiles(counts: DataFrame, value: str, weight: str, fractions: Sequence[float]) -> list[float]:
    """Exact quantiles of a count table (one row per value) at many fractions: a value answers for the ranks that it holds.

    The ranks are at most two for each fraction, so that few rows leave the table; these are put together on the driver.
    """
    run = running_totals(counts.select(value, F.col(weight).alias("_n")), value, ["_n"], kept=True)
    n = (counts.agg(F.sum(weight)).first()[0] or 0) - 1
    places = [f * n for f in fractions]
    wanted = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    held = F.filter(F.array(*[F.lit(k).cast("long") for k in wanted]), lambda k: (k >= F.col("before__n")) & (k < F.col("before__n") + F.col("_n")))
    at = {r.k: r.v for r in run.select(F.col(value).cast("double").alias("v"), F.explode(held).alias("k")).collect()}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places] if n >= 0 else []


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per value (within by): _n rows and their rank, ties averaged."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return running_totals(counted, value, ["_n"], by).withColumn("rank", F.col("before__n") + (F.col("_n") + 1) / 2)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of the rows where neither is null: one row per group of by."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c")).persist()
    rx = running_totals(both.groupBy(*by, "_x").agg(F.sum("_c").alias("_n")), "_x", ["_n"], by).select(*by, "_x", (F.col("before__n") + (F.col("_n") + 1) / 2).alias("_rx"))
    ry = running_totals(both.groupBy(*by, "_y").agg(F.sum("_c").alias("_n")), "_y", ["_n"], by).select(*by, "_y", (F.col("before__n") + (F.col("_n") + 1) / 2).alias("_ry"))
    ranked = both.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    s = lambda e: F.sum(e * F.col("_c"))
    a, b = F.col("_rx"), F.col("_ry")
    m = ranked.groupBy(*by).agg(F.sum("_c").alias("n"), s(a).alias("a"), s(b).alias("b"), s(a * a).alias("aa"), s(b * b).alias("bb"), s(a * b).alias("ab"))
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    return m.select(*by, "n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"))
