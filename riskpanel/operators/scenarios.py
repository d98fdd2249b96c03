"""Macro terms in a panel and its models: joined terms, scenario paths, projections of fitted models, stress from coefficients.

A path has one row per scenario, key and month, so it is small and bounded by scenarios x keys x months; panels are joined
with it by month and are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import losses, macro
from .estimate import Model


def term_columns(series: DataFrame, terms: Sequence[tuple[str, str, int]], by: Sequence[str] = ()) -> DataFrame:
    """One row per month (and by) with a column key@transform@lag for each term."""
    wide = None
    for key, transform, lag in terms:
        own = series.filter(F.col("key") == key)
        if by:  # transforms go by key: a scenario's series has a key of its own
            own = own.withColumn("key", F.concat_ws("|", *by, "key"))
        t = macro.transformed(own, [transform])
        t = t.select(*[F.split("key", r"\|")[i].alias(b) for i, b in enumerate(by)], F.add_months("month", lag).alias("month"), F.col("value").alias(f"{key}@{transform}@{lag}"))
        wide = t if wide is None else wide.join(t, [*by, "month"], "full_outer")
    return wide


def with_terms(panel: DataFrame, series: DataFrame, terms: Sequence[tuple[str, str, int]]) -> DataFrame:
    """panel with the terms' values at its performance month; null where a series has none."""
    path = term_columns(series, terms).withColumnRenamed("month", "performance_date")
    return panel.join(F.broadcast(path), "performance_date", "left")


def joined_scenarios(domestic: DataFrame, international: DataFrame) -> DataFrame:
    """Two scenario tables, wide by variable, on scenario and month; a month that only one of them has is kept."""
    return domestic.join(international, ["scenario", "month"], "full_outer")


def scenario_paths(history: DataFrame, paths: DataFrame, rebased: Sequence[str] = (), overrides: DataFrame | None = None) -> DataFrame:
    """history (key, month, value) spliced to each scenario's path (scenario, key, month, value): scenario, key, month, value, projected.

    overrides (scenario, key, month, value) take the place of path values before the splice. Transforms are made on what
    comes out, so that growth in the first projected months is that of the spliced series; inner gaps are filled.
    """
    if overrides is not None:
        new = overrides.select("scenario", "key", "month", F.col("value").alias("_own"))
        paths = paths.join(F.broadcast(new), ["scenario", "key", "month"], "left").select("scenario", "key", "month", F.coalesce("_own", "value").alias("value"))
    named = lambda df: df.withColumn("key", F.concat_ws("|", "scenario", "key")).drop("scenario")
    scenarios = F.broadcast(paths.select("scenario").distinct())
    past = history.crossJoin(scenarios)
    both = macro.spliced(named(past), named(paths), []) if not rebased else _rebased(named(past), named(paths), rebased)
    filled = macro.filled(both)
    return filled.select(F.split("key", r"\|")[0].alias("scenario"), F.split("key", r"\|")[1].alias("key"), "month", "value", "projected")


def _rebased(past: DataFrame, paths: DataFrame, rebased: Sequence[str]) -> DataFrame:
    names = [f"{r.s}|{k}" for r in paths.select(F.split("key", r"\|")[0].alias("s")).distinct().collect() for k in rebased]  # scenarios
    return macro.spliced(past, paths, names)


def winsorized(terms: DataFrame, names: Sequence[str], as_of: str, fit_from: str) -> DataFrame:
    """Terms by scenario and month whose values after as_of are within the range from fit_from to as_of, which keeps the model inside its evidence and caps the stress."""
    w = Window.partitionBy("scenario")
    date = lambda d: F.lit(d).cast("date")
    seen = (F.col("month") >= date(fit_from)) & (F.col("month") <= date(as_of))
    new = {}
    for n in names:
        x, known = F.col(n), F.when(seen, F.col(n))
        lo, hi = F.min(known).over(w), F.max(known).over(w)
        new[n] = F.when(x.isNotNull() & (F.col("month") > date(as_of)), F.greatest(F.coalesce(lo, x), F.least(F.coalesce(hi, x), x))).otherwise(x)
    return terms.withColumns(new)


def as_of_book(panel: DataFrame, as_of: str, target: str = "default_flag") -> DataFrame:
    """The open accounts of a reporting date."""
    return panel.filter((F.col("performance_date") == F.lit(as_of).cast("date")) & (F.col(target) == 0))


def projected(book: DataFrame, as_of: str, pd: Model, lgd: Model | Column, terms: DataFrame, horizon: int, cpr: float = 0.0) -> DataFrame:
    """Projection of fitted models over macro paths: book x scenarios x months ahead, with pd, lgd, ead, df and survival.

    terms: scenario, month and the models' macro columns. Drivers that age do so: months_on_book grows with t.
    """
    ahead = terms.filter(F.col("month") > F.lit(as_of).cast("date")).withColumn("t", F.months_between("month", F.lit(as_of).cast("date")).cast("int")).filter(F.col("t") <= horizon)
    rows = book.crossJoin(F.broadcast(ahead)).withColumn("months_on_book", F.col("months_on_book") + F.col("t"))
    rows = rows.select(
        "scenario", "account_id", "t", "segment", "current_balance", pd.score().alias("pd"), (lgd.score() if isinstance(lgd, Model) else lgd).alias("lgd"),
        losses.scheduled_balance(F.col("current_balance"), F.col("interest_rate"), F.col("remaining_term"), F.col("t"), cpr).alias("ead"), losses.discount_factor(F.col("interest_rate"), F.col("t")).alias("df"),
    )
    return losses.with_survival(rows)


def weighted(by_scenario: DataFrame, weights: dict[str, float], *keys: str) -> DataFrame:
    """by_scenario (scenario, keys, ecl, exposure) with rows "weighted": the mean loss under the scenarios' weights."""
    w = F.coalesce(*[F.when(F.col("scenario") == s, float(v)) for s, v in weights.items()], F.lit(0.0))
    mean = by_scenario.groupBy(*keys).agg(F.round(F.sum(F.col("ecl") * w) / F.sum(w), 4).alias("ecl"), F.max("exposure").alias("exposure")).withColumn("scenario", F.lit("weighted"))
    return by_scenario.select("scenario", *keys, "ecl", "exposure").unionByName(mean)


def stress_from_coefficients(terms: DataFrame, coefficients: dict[str, float], as_of: str, severity: Sequence[str]) -> DataFrame:
    """By scenario the greatest shift of the log odds that its path gives after as_of, and whether it isn't less than that of the milder scenario before it.

    severity: scenarios from the mildest on. No row of a panel is read: coefficient times the term's move since as_of.
    """
    date = F.lit(as_of).cast("date")
    start = Window.partitionBy("scenario")
    shift = F.lit(0.0)
    for name, beta in coefficients.items():
        shift = shift + beta * (F.col(name) - F.max(F.when(F.col("month") == date, F.col(name))).over(start))
    moved = terms.withColumn("_shift", shift).filter(F.col("month") > date)
    peak = moved.groupBy("scenario").agg(F.max("_shift").alias("peak"), F.max_by("month", "_shift").alias("peak_month"))
    order = F.coalesce(*[F.when(F.col("scenario") == s, F.lit(i)) for i, s in enumerate(severity)])
    known = peak.withColumn("place", order).filter("place IS NOT NULL")
    before = F.lag("peak").over(Window.partitionBy(F.lit(1)).orderBy("place"))  # a row of each scenario
    return known.select("scenario", "place", F.round("peak", 6).alias("peak"), "peak_month", F.coalesce(F.col("peak") >= before - 1e-12, F.lit(True)).alias("monotone"))


def macro_tornado(book: DataFrame, as_of: str, pd: Model, lgd: Model | Column, terms: DataFrame, horizon: int, fit_from: str, base: str = "base") -> DataFrame:
    """By macro term of the default model: its standard deviation from fit_from to as_of, the expected loss of the base path, and that after moving the term one
    deviation the adverse way in all months ahead; the greatest change first (place).

    All shocks are scenarios of one projection.
    """
    beta = dict(zip(pd.names, pd.beta, strict=True))
    moved = {t.column: 1 if beta[t.column] * t.sd > 0 else -1 for t in pd.terms if t.column in terms.columns and beta.get(t.column)}
    own, date = terms.filter(F.col("scenario") == base), lambda d: F.lit(d).cast("date")
    seen = (F.col("month") >= date(fit_from)) & (F.col("month") <= date(as_of))
    # One row of deviations, which all months get.
    sd = own.agg(*[F.stddev_pop(F.when(seen, F.col(t))).alias(f"sd {t}") for t in moved]) if moved else None
    wide = own.join(F.broadcast(sd)) if moved else own
    shocks = wide.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in [base, *moved]])))
    ahead = F.col("month") > date(as_of)
    shocks = shocks.withColumns({t: F.when(ahead & (F.col("scenario") == t), F.col(t) + sign * F.col(f"sd {t}")).otherwise(F.col(t)) for t, sign in moved.items()})
    loss = losses.losses(projected(book, as_of, pd, lgd, shocks.select(terms.columns), horizon)).select("scenario", "ecl")
    whole = loss.filter(F.col("scenario") == base).select(F.col("ecl").alias("base_ecl"))
    sds = F.create_map(*[x for t in moved for x in (F.lit(t), F.col(f"sd {t}"))]) if moved else F.lit(None)
    out = loss.filter(F.col("scenario") != base).join(F.broadcast(whole)).join(F.broadcast(sd)) if moved else loss.filter("false").withColumn("base_ecl", F.col("ecl"))
    out = out.select(F.col("scenario").alias("term"), (sds[F.col("scenario")] if moved else F.lit(None).cast("double")).alias("sd"), "base_ecl", F.col("ecl").alias("shocked_ecl"), (F.col("ecl") - F.col("base_ecl")).alias("change"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.abs("change")), "term")))  # a row of each macro term


def smoothness(terms: DataFrame, name: str) -> DataFrame:
    """By scenario the greatest second difference of a path, in size."""
    w = Window.partitionBy("scenario").orderBy("month")
    x = F.col(name)
    bend = F.abs(x - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w))
    return terms.withColumn("_bend", bend).groupBy("scenario").agg(F.round(F.max("_bend"), 6).alias("roughness"))


def sign_checks(coefficients: dict[str, float], priors: dict[str, int]) -> list[tuple[str, float, int | None, str]]:
    """(term, coefficient, prior, verdict): whether each coefficient has the sign that is expected of its column."""
    out = []
    for name, beta in coefficients.items():
        want = priors.get(name)
        out.append((name, beta, want, "no prior" if not want else "agrees" if beta * want > 0 else "contradicts"))
    return out
