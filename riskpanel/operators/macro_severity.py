"""Macro terms against the severity of single loans: rank correlation with an effective size, from counts by month and severity.

A macro term is constant within a month, so ranks of severities are needed as sums by month only. Severities are
counted by month and value once. Candidates that cover the same months share the severities' ranks: these are taken for
each cover, not for each candidate, by exact running totals. What is left is a row for each candidate and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, month_of, period_of, student_tail
from .ranks import running_totals

#: Defaults that a correlation needs, and months from which serial correlation is taken into account.
LEAST_DEFAULTS, LEAST_MONTHS = 30, 12


def severity_counts(panel: DataFrame, target: str, severity: str = "lgd_realised", date: str = "performance_date") -> DataFrame:
    """month, severity (within [0, 1]) and n: the rows of each value of the defaults that have a severity."""
    seen = panel.filter((F.col(target) == 1) & F.col(severity).isNotNull() & ~F.isnan(F.col(severity).cast("double")))
    return seen.groupBy(month_of(F.col(date)).alias("month"), clamp(F.col(severity).cast("double"), 0.0, 1.0).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def effective_size(months: Column, auto_x: Column, auto_y: Column) -> Column:
    """Months after serial correlation of both series; as many as there are, if these are few."""
    rho = clamp(auto_x * auto_y, -0.99, 0.99)
    return F.when(months < LEAST_MONTHS, months.cast("double")).otherwise(F.greatest(F.lit(4.0), months * (1 - rho) / (1 + rho)))


def rank_correlations(candidates: DataFrame, counts: DataFrame, least: int = LEAST_DEFAULTS) -> DataFrame:
    """By candidate (candidate, month, value) n defaults, months, the effective size, Spearman's r, t and p.

    A hundred defaults of a month are one observation of a macro term: the effective size is that of the months, at most
    their number. r, t and p are null where there are fewer defaults than least, or where the term or all severities are constant.
    """
    sized = counts.groupBy("month").agg(F.sum("n").alias("n"))
    # Months are few whatever the rows; a candidate has one row of each.
    own = candidates.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(sized), "month").select("candidate", "month", F.col("value").alias("x"), "n")
    covers = own.groupBy("candidate").agg(F.xxhash64(F.array_sort(F.collect_list("month"))).alias("cover"))
    own = own.join(covers, "candidate")
    within = own.select("cover", "month").distinct()
    values = within.join(counts, "month").groupBy("cover", "severity").agg(F.sum("n").alias("_n"))
    y = running_totals(values, "severity", ["_n"], ["cover"]).select("cover", "severity", "_n", (F.col("before__n") + (F.col("_n") + 1) / 2).alias("rank"))
    spread = y.groupBy("cover").agg(F.sum(F.col("_n") * F.col("rank") * F.col("rank")).alias("yy"))
    by_month = within.join(counts, "month").join(y.select("cover", "severity", "rank"), ["cover", "severity"]).groupBy("cover", "month").agg(F.sum(F.col("n") * F.col("rank")).alias("y"))
    # Ranks of the term: months of equal value share theirs.
    tied = own.groupBy("candidate", "x").agg(F.sum("n").alias("_t"))
    below = Window.partitionBy("candidate").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.select("candidate", "x", (F.coalesce(F.sum("_t").over(below), F.lit(0)) + (F.col("_t") + 1) / 2).alias("rx"))
    rows = own.join(tied, ["candidate", "x"]).join(by_month, ["cover", "month"])
    series = Window.partitionBy("candidate")
    rows = rows.withColumn("dx", F.col("x") - F.avg("x").over(series))
    rows = rows.withColumn("lagged", F.col("dx") * F.lag("dx").over(series.orderBy("month")))
    n, rx = F.col("n"), F.col("rx")
    m = rows.groupBy("candidate", "cover").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("months"), F.sum(rx * F.col("y")).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(F.col("dx") * F.col("dx")).alias("s"), F.sum("lagged").alias("l"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    m = m.join(spread, "cover")
    # In doubles: the cube of some two million defaults is beyond a long.
    mean = n.cast("double") * (n + 1) * (n + 1) / 4
    vx, vy = F.col("xx") - mean, F.col("yy") - mean
    auto = F.coalesce(F.col("l") / F.nullif("s", F.lit(0.0)), F.lit(0.0))
    size = F.least(F.col("months").cast("double"), effective_size(F.col("months"), auto, auto))
    enough = (n >= least) & (F.col("hi") - F.col("lo") > 1e-12) & (vy > 1e-6)
    out = m.withColumns({"n_effective": F.when(enough, size), "r": F.when(enough, (F.col("xy") - mean) / F.sqrt(vx * vy))})
    free = (F.col("n_effective") > 2) & (F.abs("r") < 1)
    out = out.withColumn("t", F.when(free, F.col("r") * F.sqrt((F.col("n_effective") - 2) / (1 - F.col("r") * F.col("r")))))
    return out.select("candidate", "n", "months", "n_effective", "r", "t", student_tail(F.col("t"), F.col("n_effective") - 2).alias("p"))


def candidate_series(candidates: DataFrame, log_odds: DataFrame, counts: DataFrame) -> DataFrame:
    """candidate, month, value, log_odds and severity: each term beside both targets, over the months from the first to the last log odds.

    severity: the mean of its quarter's defaults, as single months have few.
    """
    quarter = counts.groupBy(period_of(F.col("month"), "QS").alias("quarter")).agg((F.sum(F.col("n") * F.col("severity")) / F.sum("n")).alias("severity"))
    ends = log_odds.agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    rows = candidates.join(F.broadcast(ends)).filter(F.col("month").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    rows = rows.join(F.broadcast(log_odds.select("month", F.col("y").alias("log_odds"))), "month", "left")
    return rows.withColumn("quarter", period_of(F.col("month"), "QS")).join(F.broadcast(quarter), "quarter", "left").select("candidate", "month", "value", "log_odds", "severity")
