"""Scalar functions on Columns: rates, logits, dates, discounting, scores, bins and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PD_CLIP, SEVERITY_CLIP = 35.0, 30.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def annualize(monthly: Column) -> Column:
    """Percent a year from a monthly hazard, clipped to [0, 1]."""
    return (1 - F.pow(1 - clamp(monthly, 0.0, 1.0), F.lit(12))) * 100


def deannualize(annual_percent: Column) -> Column:
    return 1 - F.pow(1 - annual_percent / 100, F.lit(1.0 / 12))


def sigmoid(x: Column, clip: float = PD_CLIP) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -clip, clip)))


def logit(p: Column, clip: float = 1e-4) -> Column:
    q = clamp(p, clip, 1 - clip)
    return F.log(q / (1 - q))


def month_of(date: Column) -> Column:
    return F.trunc(date.cast("date"), "month")


def period_of(date: Column, freq: str) -> Column:
    """Start of the month (MS), quarter (QS) or year (YS) as a date."""
    return F.trunc(date.cast("date"), {"MS": "month", "QS": "quarter", "YS": "year"}[freq])


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def months_on_book(performance: Column, origination: Column) -> Column:
    """Whole months from origination to performance, 0 at least."""
    return F.greatest(F.lit(0), month_index(performance) - month_index(origination))


def bin_index(x: Column, edges: Column | Sequence[float]) -> Column:
    """Number of edges at or below x (bins are left-closed); -1 for null."""
    if isinstance(edges, Column):
        found = F.size(F.filter(edges, lambda e: e <= x))
    else:
        found = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(x.isNull(), F.lit(-1)).otherwise(found).cast("int")


def discount_factor(annual_rate: Column, t: Column) -> Column:
    return F.pow(1 + F.greatest(annual_rate, F.lit(0.0)) / 12, -t)


def level_payment(balance: Column, annual_rate: Column, term: Column) -> Column:
    r = annual_rate / 12
    return F.when(r > 0, balance * r / (1 - F.pow(1 + r, -term))).otherwise(balance / term)


def scheduled_balance(balance: Column, annual_rate: Column, term: Column, t: Column, cpr: float = 0.0) -> Column:
    """Balance after t payments of a level-payment loan, less prepayments of cpr a year; flat where rate or term is null."""
    r = annual_rate / 12
    grown = F.pow(1 + r, t)
    left = F.when(r > 0, balance * grown - level_payment(balance, annual_rate, term) * (grown - 1) / r).otherwise(balance * (1 - t / term))
    paid = F.greatest(F.lit(0.0), left) * F.pow(F.lit(1 - cpr), t / 12)
    return F.when(annual_rate.isNull() | term.isNull(), balance).when(t >= term, F.lit(0.0)).otherwise(paid)


def ccf_exposure(drawn: Column, committed: Column, ccf: float) -> Column:
    return drawn + F.lit(ccf) * F.greatest(committed - drawn, F.lit(0.0))


def score_points(p: Column, base_score: float = 600.0, base_odds: float = 50.0, pdo: float = 20.0) -> Column:
    """Scorecard points: base_score at base_odds, pdo more points where the odds double."""
    q = clamp(p, 1e-9, 1 - 1e-9)
    factor = F.lit(pdo) / F.log(F.lit(2.0))
    return F.lit(base_score) - factor * F.log(F.lit(base_odds)) + factor * F.log((1 - q) / q)


def finite(x: Column) -> Column:
    """x, with null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def steady_mean(x: Column) -> Column:
    """Mean of x, whatever the order of the rows: whole parts are summed exactly, so that only their fractions round."""
    whole = F.floor(x)
    return (F.sum(whole.cast("decimal(20,0)")).cast("double") + F.sum(x - whole)) / F.count(x)


def counted_mean(x: Column, n: Column) -> Column:
    """Mean of x over rows that stand for n rows each; those without x are left out."""
    return F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))


def macro_family(key: Column) -> Column:
    """A macro key without its rate suffix."""
    return F.regexp_replace(key, "_(yoy|growth)$", "")


def candidate_name(key: Column, transform: Column, lag: Column) -> Column:
    return F.concat_ws("@", key, transform, lag.cast("string"))


def log_product(x: Column) -> Column:
    """ln of a factor for running products; factors of 0 give a great negative number, so that the product is 0."""
    return F.when(x <= 0, F.lit(-800.0)).otherwise(F.log(x))


def student_tail(t: Column, df: Column, steps: int = 400) -> Column:
    """Two-sided p-value of Student's t with df degrees of freedom, 2 at least, which need not be whole.

    With t = sqrt(df) / tan(a) the tail is the integral of sin(x)^(df - 1) up to a over that up to pi / 2, which Simpson's rule
    takes in u, x = a u^2, where it is smooth at 0.
    """

    def area(a: Column) -> Column:
        def term(total: Column, i: Column) -> Column:
            u = i / float(steps)
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return total + weight * F.pow(F.sin(a * u * u), df - 1) * 2 * a * u

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), term)

    return F.when(t.isNotNull() & df.isNotNull(), area(F.atan2(F.sqrt(df), F.abs(t))) / area(F.lit(1.5707963267948966)))
