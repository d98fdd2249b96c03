"""Exposure paths, lifetime expected loss, staging, attribution and shocks.

A projection is long: one row per scenario, account and month ahead, with pd, lgd, ead and df. Scenarios are a column,
not a loop. All windows are by scenario and account, whose rows are made next to each other by explode.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, discount_factor, log_product, scheduled_balance
from .ranks import quantiles

#: Fixed values of the staging trigger: multiple of the median and absolute 12-month default rate.
SICR_MULTIPLE, SICR_ABSOLUTE = 2.0, 0.005
FACTORS = ["pd", "survival", "lgd", "ead"]


def open_book(panel: DataFrame, target: str = "default_flag") -> DataFrame:
    """Each account's last row, of accounts that have not defaulted (or ended, where the panel says so)."""
    live = (F.max(target).over(Window.partitionBy("account_id")) == 0) if "terminal_event" not in panel.columns else F.col("terminal_event").isin("none", "censored")
    last = F.col("performance_date") == F.max("performance_date").over(Window.partitionBy("account_id"))
    return panel.withColumns({"_live": live, "_last": last}).filter("_live AND _last").drop("_live", "_last")


def ccf(panel: DataFrame, months: int = 12, target: str = "default_flag", drawn: str = "current_balance", committed: str = "committed_amount") -> DataFrame:
    """Credit conversion from defaults and the same accounts' rows months earlier: n and the mean of the drawn share of what was undrawn, within [0, 1]."""
    d = panel.filter(F.col(target) == 1).select("account_id", F.add_months("performance_date", -months).alias("performance_date"), F.col(drawn).alias("at_default"))
    before = panel.select("account_id", "performance_date", F.col(drawn).alias("drawn"), F.col(committed).alias("limit"))
    both = d.join(before, ["account_id", "performance_date"]).filter("limit > drawn")
    x = clamp((F.col("at_default") - F.col("drawn")) / (F.col("limit") - F.col("drawn")), 0.0, 1.0)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 8).alias("ccf"))


def expanded(book: DataFrame, horizon: int, scenarios: Sequence[tuple]) -> DataFrame:
    """book with scenario, its factors m_pd, m_lgd and m_ead, and t from 1 to the horizon."""
    path = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(float(a)).alias("m_pd"), F.lit(float(b)).alias("m_lgd"), F.lit(float(c)).alias("m_ead")) for s, a, b, c in scenarios])
    return book.select("*", F.explode(path).alias("_s")).select("*", "_s.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("t")).drop("_s")


def projection(book: DataFrame, pd: Column, lgd: Column, horizon: int, scenarios: Sequence[tuple], cpr: float = 0.0) -> DataFrame:
    """The projection with survival: pd and lgd are expressions on book and t, multiplied by the scenario's factors."""
    rows = expanded(book, horizon, scenarios)
    ead = scheduled_balance(F.col("current_balance"), F.col("interest_rate"), F.col("remaining_term"), F.col("t"), cpr) * F.col("m_ead")
    rows = rows.select(
        "scenario", "account_id", "t", "segment", "current_balance", clamp(pd * F.col("m_pd"), 0.0, 0.999).alias("pd"), clamp(lgd * F.col("m_lgd"), 0.0, 1.0).alias("lgd"),
        ead.alias("ead"), discount_factor(F.col("interest_rate"), F.col("t")).alias("df"),
    )
    return with_survival(rows)


def with_survival(rows: DataFrame) -> DataFrame:
    """survival: the product of 1 - pd over the months before; 1 for the first."""
    before = Window.partitionBy("scenario", "account_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("survival", F.coalesce(F.exp(F.sum(log_product(1 - F.col("pd"))).over(before)), F.lit(1.0)))


def loss() -> Column:
    return F.col("pd") * F.col("survival") * F.col("lgd") * F.col("ead") * F.col("df")


def losses(rows: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Lifetime loss, 12-month loss, accounts and exposure by scenario or any other columns."""
    first = F.col("t") == 1
    return rows.groupBy(*by).agg(F.round(F.sum(loss()), 4).alias("ecl"), F.round(F.sum(F.when(F.col("t") <= 12, loss())), 4).alias("ecl_12"), F.count_if(first).alias("accounts"), F.round(F.sum(F.when(first, F.col("current_balance"))), 2).alias("exposure"))


def monthly(rows: DataFrame) -> DataFrame:
    """By scenario and month: loss, cumulative loss, mean survival, exposure."""
    m = rows.groupBy("scenario", "t").agg(F.sum(loss()).alias("l"), F.avg("survival").alias("s"), F.sum("ead").alias("e"))
    w = Window.partitionBy("scenario").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("scenario", "t", F.round("l", 4).alias("loss"), F.round(F.sum("l").over(w), 4).alias("cumulative_loss"), F.round("s", 8).alias("survival"), F.round("e", 2).alias("exposure"))


def account_losses(rows: DataFrame) -> DataFrame:
    """By scenario and account: lifetime and 12-month loss, and 12-month default rate."""
    year = F.col("t") <= 12
    return rows.groupBy("scenario", "account_id").agg(
        F.sum(loss()).alias("ecl"), F.sum(F.when(year, loss())).alias("ecl_12"), (1 - F.exp(F.sum(F.when(year, log_product(1 - F.col("pd")))))).alias("pd_12"), F.max("current_balance").alias("balance"),
    )


def staged(rows: DataFrame) -> DataFrame:
    """Staging by scenario: stage 2 where the 12-month rate is over twice the median or over 0.5 %; stage 1 bears the 12-month loss."""
    each = account_losses(rows)
    median = quantiles(each, "pd_12", [0.5], ["scenario"])
    own = each.join(F.broadcast(median), "scenario")
    high = (F.col("pd_12") > SICR_MULTIPLE * F.greatest(F.col("q")[0], F.lit(1e-9))) | (F.col("pd_12") > SICR_ABSOLUTE)
    out = own.withColumn("stage", F.when(high, 2).otherwise(1))
    return out.groupBy("scenario", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("exposure"), F.round(F.sum(F.when(F.col("stage") == 1, F.col("ecl_12")).otherwise(F.col("ecl"))), 4).alias("ecl"))


def paired(rows: DataFrame, base: str, stress: str) -> DataFrame:
    """One row per account and month with the factors of both scenarios, b_ and s_, in one aggregate."""
    pick = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    return rows.filter(F.col("scenario").isin(base, stress)).groupBy("account_id", "t").agg(*[pick(s, c).alias(f"{p}_{c}") for p, s in (("b", base), ("s", stress)) for c in [*FACTORS, "df"]])


def _value(stressed: Sequence[str]) -> Column:
    out = F.col("b_df")
    for f in FACTORS:
        out = out * F.col(f"s_{f}" if f in stressed else f"b_{f}")
    return F.sum(out)


def bridge(rows: DataFrame, base: str, stress: str) -> DataFrame:
    """From one loss to the other, one factor after another: step, label, delta, running. The steps add up to the difference."""
    last = F.sum(F.col("s_df") * F.col("s_pd") * F.col("s_survival") * F.col("s_lgd") * F.col("s_ead"))
    one = paired(rows, base, stress).agg(*[_value(FACTORS[:i]).alias(f"e{i}") for i in range(5)], last.alias("e5"))
    e = [F.col(f"e{i}") for i in range(6)]
    steps = [(base, e[0], e[0])] + [(f, e[i + 1] - e[i], e[i + 1]) for i, f in enumerate(FACTORS)] + [("interaction", e[5] - e[4], e[5]), (stress, e[5], e[5])]
    row = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), F.round(d, 4).alias("delta"), F.round(r, 4).alias("running")) for i, (n, d, r) in enumerate(steps)]
    return one.select(F.explode(F.array(*row)).alias("x")).select("x.*")


def shapley(rows: DataFrame, base: str, stress: str) -> DataFrame:
    """Each factor's mean contribution over all orders: the sixteen subsets' losses come from one aggregate."""
    subsets = [s for k in range(5) for s in combinations(FACTORS, k)]
    one = paired(rows, base, stress).agg(*[_value(s).alias("_".join(["v", *s])) for s in subsets])
    out = []
    for f in FACTORS:
        total = F.lit(0.0)
        for s in subsets:
            if f not in s:
                weight = factorial(len(s)) * factorial(3 - len(s)) / factorial(4)
                grown = "_".join(["v", *[x for x in FACTORS if x in s or x == f]])
                total = total + weight * (F.col(grown) - F.col("_".join(["v", *s])))
        out.append(F.struct(F.lit(f).alias("factor"), F.round(total, 4).alias("contribution")))
    return one.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def tornado(book: DataFrame, pd: Column, lgd: Column, horizon: int, shocks: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Change of the loss under each shock alone, and its place by size from 1: the shocks are scenarios of one projection."""
    rows = projection(book, pd, lgd, horizon, [("", 1, 1, 1), *[(k, *v) for k, v in shocks.items()]])
    e = losses(rows).select("scenario", "ecl")
    base = e.filter("scenario = ''").select(F.col("ecl").alias("_base"))
    deltas = e.filter("scenario != ''").crossJoin(F.broadcast(base)).select(F.col("scenario").alias("shock"), F.round(F.col("ecl") - F.col("_base"), 4).alias("delta"))
    # As many rows as shocks.
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.abs("delta")), "shock"))
    return deltas.withColumn("place", place).orderBy("place")


def firm_rollup(by_book: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Losses of all books by scenario, and their mean under scenario weights, with totals over books (book null)."""
    total = by_book.rollup("scenario", "book").agg(F.round(F.sum("ecl"), 4).alias("ecl"), F.round(F.sum("exposure"), 2).alias("exposure")).filter("scenario IS NOT NULL")
    w = F.coalesce(*[F.when(F.col("scenario") == s, float(v)) for s, v in weights.items()], F.lit(0.0))
    mean = total.groupBy("book").agg(F.round(F.sum(F.col("ecl") * w) / F.sum(w), 4).alias("ecl"), F.round(F.max("exposure"), 2).alias("exposure")).withColumn("scenario", F.lit("weighted"))
    return total.unionByName(mean)


def weighted_rates(rows: DataFrame) -> DataFrame:
    """By scenario the 12-month default rate and the mean severity of the first year, weighted by balances (1 at least)."""
    year = F.col("t") <= 12
    each = rows.groupBy("scenario", "account_id").agg((1 - F.exp(F.sum(F.when(year, log_product(1 - F.col("pd")))))).alias("pd"), F.avg(F.when(year, F.col("lgd"))).alias("lgd"), F.greatest(F.max("current_balance"), F.lit(1.0)).alias("w"))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 8)
    return each.groupBy("scenario").agg(mean("pd").alias("pd_12"), mean("lgd").alias("lgd"))


def exposure_assumption(columns: Sequence[str], method: str | None = None, ccf: float | None = None, cpr: float = 0.0) -> dict:
    """How exposure at default is taken, chosen by what a panel has unless a method is named, with a sentence that says so."""
    chosen = method or ("ccf" if "committed_amount" in columns and ccf is not None else "amortising" if {"interest_rate", "remaining_term"} <= set(columns) else "flat")
    said = {
        "ccf": f"Exposure is what is drawn and {100 * (ccf or 0):.0f} % of what is not.",
        "amortising": f"Exposure follows the payment schedule, with {100 * cpr:.1f} % prepaid a year.",
        "flat": "Exposure stays at the last balance, as no schedule is known.",
    }
    if chosen not in said:
        raise ValueError(f"no such exposure method: {chosen}")
    return {"method": chosen, "ccf": ccf, "cpr": cpr, "statement": said[chosen]}


def exposure_by_ccf(book: DataFrame, horizon: int, ccf: float) -> DataFrame:
    """Flat exposure of facilities over the months ahead: drawn and a share of the undrawn amount."""
    from ..functions.exprs import ccf_exposure

    return book.select("account_id", ccf_exposure(F.col("current_balance"), F.col("committed_amount"), ccf).alias("ead"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("t"))
