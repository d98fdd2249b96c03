"""Panel quality: default rates over time, integrity, column profiles, distributions and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import annualize, month_index, period_of
from ..sources.panels import unpivoted
from .ranks import quantiles

#: Points that a failed check costs; five are the most.
SEVERITY_POINTS = {"critical": 5.0, "serious": 3.0, "warning": 1.0}
PLAUSIBLE_RATE, LEAST_YEARS = (0.1, 25.0), 3


def default_rates(panel: DataFrame, by: Sequence[str] = (), freq: str = "MS", target: str = "default_flag", balance: str = "current_balance") -> DataFrame:
    """Rows, defaults, exposure, monthly and annualised default rate by period (and by)."""
    g = panel.groupBy(period_of(F.col("performance_date"), freq).alias("period"), *by)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("defaults"), F.round(F.sum(balance), 2).alias("exposure"))
    rate = F.col("defaults") / F.col("n")
    return out.select("period", *by, "n", "defaults", "exposure", F.round(rate, 8).alias("rate"), F.round(annualize(rate), 6).alias("annual_pct"))


def summary(panel: DataFrame, target: str = "default_flag") -> DataFrame:
    """One row: rows, accounts, defaults, annual rate, window, and a digest of the content."""
    out = panel.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("account_id").alias("accounts"), F.sum(target).alias("defaults"), F.min("performance_date").alias("first_month"), F.max("performance_date").alias("last_month"), F.round(F.sum("current_balance"), 0).alias("balance"))
    rate = F.round(annualize(F.col("defaults") / F.col("n_rows")), 6).alias("annual_pct")
    digest = F.sha2(F.concat_ws("|", "n_rows", "accounts", "defaults", F.date_format("first_month", "yyyy-MM-dd"), F.date_format("last_month", "yyyy-MM-dd"), F.col("balance").cast("decimal(38,0)").cast("string")), 256)
    return out.select("n_rows", "accounts", "defaults", "first_month", "last_month", rate, F.substring(digest, 1, 12).alias("fingerprint"))


def integrity(panel: DataFrame, target: str = "default_flag") -> DataFrame:
    """The panel's checks: check, passed, severity (good if passed), n_affected. One shuffle by account serves all.

    A check whose column is absent is left out.
    """
    own = Window.partitionBy("account_id")
    seq = own.orderBy("performance_date")
    step = month_index(F.col("performance_date")) - F.lag(month_index(F.col("performance_date"))).over(seq)
    first = F.min(F.when(F.col(target) == 1, F.col("performance_date"))).over(own)
    rows = panel.withColumns({"_step": step, "_first": first, "_same": (F.lag("performance_date").over(seq) == F.col("performance_date"))})
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    per = [F.count(F.lit(1)).alias("n"), count(F.col("_same")).alias("dup"), count((F.col("_step") != 1)).alias("gaps"), F.sum(target).alias("fired"), count(F.col("performance_date") > F.col("_first")).alias("after"), F.min("performance_date").alias("lo"), F.max("performance_date").alias("hi")]
    has = lambda c: c in panel.columns
    per += [count(F.col("current_balance") < 0).alias("neg")] if has("current_balance") else []
    per += [count(F.col("performance_date") < F.col("origination_date")).alias("early")] if has("origination_date") else []
    if has("terminal_event"):
        last = F.max("performance_date").over(own)
        rows = rows.withColumn("_over", F.col("terminal_event").isin("default", "payoff", "matured") & (F.col("performance_date") != last))
        per += [count(F.col("_over")).alias("over")]
    accounts = rows.groupBy("account_id").agg(*per)
    total = accounts.agg(
        *[F.sum(c).alias(c) for c in accounts.columns if c in ("n", "dup", "gaps", "fired", "after", "neg", "early", "over")],
        F.count_if(F.col("fired") > 1).alias("multi"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    rate = annualize(F.col("fired") / F.col("n"))
    zero = F.lit(0).cast("long")
    none = lambda c: (F.col(c) == 0, F.col(c))
    checks = [("unique account-month key", "critical", *none("dup")), ("no gaps in the monthly sequence", "serious", *none("gaps"))]
    checks += [("no rows after a terminal event", "critical", *none("over"))] if has("terminal_event") else []
    checks += [("balances are not negative", "serious", *none("neg"))] if has("current_balance") else []
    checks += [
        ("history stops at default", "serious", *none("after")),
        ("target fires once at most", "critical", *none("multi")),
        ("default rate is plausible", "warning", (rate >= PLAUSIBLE_RATE[0]) & (rate <= PLAUSIBLE_RATE[1]), zero),
        ("window is long enough", "warning", F.datediff("hi", "lo") / 365.25 >= LEAST_YEARS, zero),
    ]
    checks += [("no performance before origination", "critical", *none("early"))] if has("origination_date") else []
    row = lambda name, severity, ok, n: F.struct(F.lit(name).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("passed"), F.when(ok, "good").otherwise(severity).alias("severity"), n.cast("long").alias("n_affected"))
    return total.select(F.explode(F.array(*[row(*c) for c in checks])).alias("x")).select("x.*")


def health_score(checks: DataFrame) -> DataFrame:
    """0 to 100: a failed check costs its severity's points of five for each check."""
    points = F.coalesce(*[F.when(F.col("severity") == s, p) for s, p in SEVERITY_POINTS.items()], F.lit(0.0))
    lost = F.sum(F.when(~F.col("passed"), points).otherwise(0.0))
    return checks.agg(F.round(F.greatest(F.lit(0.0), 100 * (1 - lost / (5.0 * F.count(F.lit(1))))), 1).alias("score"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


def static_columns(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and whether it never changes within an account (null counts as a value)."""
    sides = [x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count_if(F.col(c).isNull()).alias(f"no_{c}"))]
    each = panel.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), *sides)
    moves = [F.max(((F.col(f"lo_{c}") != F.col(f"hi_{c}")) | ((F.col(f"no_{c}") > 0) & (F.col(f"no_{c}") < F.col("n")))).cast("int")).alias(c) for c in columns]
    return unpivoted(each.agg(*moves), list(columns)).select(F.col("name").alias("column_name"), (F.coalesce("value", F.lit(0)) == 0).alias("static"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: missing_pct, n_unique, mean, population sd, exact quantiles, extremes, rows beyond 3 interquartile ranges.

    All are sums over one count table by column and value, which is kept.
    """
    long = unpivoted(df, list(columns)).withColumn("value", F.col("value").cast("double"))
    cells = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("c")).persist()
    q = quantiles(cells, "value", [0.01, 0.25, 0.5, 0.75, 0.99], ["name"], weight="c")
    v, c, there = F.col("value"), F.col("c"), F.col("value").isNotNull()
    mean = F.sum(v * c) / F.sum(F.when(there, c))
    means = cells.groupBy("name").agg(mean.alias("mean"))
    fence = F.col("q")[3] - F.col("q")[1]
    out = (v < F.col("q")[1] - 3 * fence) | (v > F.col("q")[3] + 3 * fence)
    each = cells.join(F.broadcast(means), "name").join(F.broadcast(q), "name", "left")
    whole = each.groupBy("name", "mean", "q").agg(
        F.sum(c).alias("n"), F.sum(F.when(there, c).otherwise(0)).alias("present"), F.count(v).alias("n_unique"), F.sum(F.when(out, c).otherwise(0)).alias("outliers"),
        F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * c) / F.sum(F.when(there, c))).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"),
    )
    r = lambda c: F.round(c, 6)
    return whole.select(
        F.col("name").alias("column_name"), r(100 * (1 - F.col("present") / F.col("n"))).alias("missing_pct"), "n_unique", F.round("mean", 9).alias("mean"), r("sd").alias("sd"),
        *[r(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((1, 25, 50, 75, 99))], F.col("lo").alias("least"), F.col("hi").alias("most"), "outliers",
    )


def top_levels(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """The k most frequent levels (null is one), ties by name."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "level").limit(k)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: sample moments (spelled out), median absolute deviation, share of the mode, zeros and negatives, whether integral, p99 / p50.

    All are sums over one count table by column and value, which is kept: df is read once.
    """
    long = unpivoted(df, list(columns)).withColumn("value", F.col("value").cast("double")).filter("value IS NOT NULL")
    cells = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("c")).persist()
    v, c = F.col("value"), F.col("c")
    q = quantiles(cells, "value", [0.5, 0.99], ["name"], weight="c")
    q = df.sparkSession.createDataFrame(q.collect(), q.schema)  # two numbers of each column
    # Values on both sides of the median may be as far from it as each other.
    far = cells.join(F.broadcast(q), "name").groupBy("name", F.abs(v - F.col("q")[0]).alias("dev")).agg(F.sum(c).alias("c")).persist()
    mad = quantiles(far, "dev", [0.5], ["name"], "mad", weight="c")
    means = cells.groupBy("name").agg((F.sum(v * c) / F.sum(c)).alias("mean"))
    d = v - F.col("mean")
    share = lambda there: F.sum(F.when(there, c).otherwise(0)) / F.sum(c)
    stats = cells.join(F.broadcast(means), "name").groupBy("name", "mean").agg(
        F.sum(c).alias("n"), *[F.sum(F.pow(d, F.lit(k)) * c).alias(f"d{k}") for k in (2, 3, 4)], share(v == 0).alias("zero"), share(v < 0).alias("negative"),
        F.min((v == F.floor(v)).cast("int")).alias("whole"), F.max(c).alias("mode_n"),
    )
    stats = stats.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.col("d2") / (F.col("n") - 1))))
    moment = lambda k: F.when(F.col("sd") > 0, F.col(f"d{k}") / F.col("n") / F.pow("sd", F.lit(k))).when(F.col("sd") == 0, float("nan"))
    out = stats.join(q, "name").join(mad, "name")
    r = lambda c, d=6: F.round(c, d)
    return out.select(
        F.col("name").alias("column_name"), "n", F.round("mean", 9).alias("mean"), r("sd").alias("sd"), r(moment(3), 5).alias("skew"), r(moment(4) - 3, 5).alias("kurtosis"), r(F.col("mad")[0]).alias("mad"),
        r(F.col("mode_n") / F.col("n")).alias("mode_share"), r(100 * F.col("zero")).alias("zero_pct"), r(100 * F.col("negative")).alias("negative_pct"), (F.col("whole") == 1).alias("integral"),
        r(F.when(F.col("q")[0] != 0, F.col("q")[1] / F.col("q")[0])).alias("tail_ratio"),
    )


def describe_categorical(df: DataFrame, columns: Sequence[str], thin: float = 0.01) -> DataFrame:
    """By column: levels, Herfindahl index, share of the top level, levels below the thin share."""
    counted = unpivoted(df, list(columns)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("name"))
    out = counted.withColumn("share", share).groupBy("name").agg(F.count("value").alias("levels"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top"), F.count_if(F.col("share") < thin).alias("thin_levels"))
    return out.select(F.col("name").alias("column_name"), "levels", F.round("hhi", 8).alias("hhi"), F.round(100 * F.col("top"), 6).alias("top_pct"), "thin_levels")


def histogram(df: DataFrame, column: str, target: str, bins: int = 48, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Equal-width bins from the least to the most value, the last one closed: bin, lo, n, events, rate (null below 50 rows)."""
    ends = df.agg((F.min(column) if lo is None else lo).cast("double").alias("_lo"), (F.max(column) if hi is None else hi).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = df.select(F.col(column).alias("_v"), F.col(target).alias("_y")).filter("_v IS NOT NULL").crossJoin(F.broadcast(ends))
    at = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width)).cast("int")
    out = rows.filter("_v >= _lo AND _v <= _hi").groupBy(at.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("events"))
    return out.select("bin", F.round(F.col("_lo") + F.col("bin") * width, 6).alias("lo"), "n", "events", F.round(F.when(F.col("n") >= 50, F.col("events") / F.col("n")), 8).alias("rate"))


def concentration(df: DataFrame, column: str, exposure: str, top: int = 8) -> DataFrame:
    """Exposure by the top levels of a column, the rest as (other), with shares."""
    each = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(exposure).alias("e"))
    best = each.orderBy(F.desc("n"), "level").limit(top).select("level", F.col("level").alias("band"))
    out = each.join(F.broadcast(best), "level", "left").groupBy(F.coalesce("band", F.lit("(other)")).alias("band")).agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return out.select("band", "n", F.round("e", 2).alias("exposure"), F.round(100 * F.col("e") / F.sum("e").over(Window.partitionBy()), 6).alias("share_pct"))


def band_concentration(df: DataFrame, column: str, exposure: str, cuts: Sequence[float]) -> DataFrame:
    """Exposure by fixed bands, which are right-closed: (lo, hi]."""
    band = sum((F.when(F.col(column) > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    out = df.filter(F.col(column).isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(exposure).alias("e"))
    return out.select("band", "n", F.round("e", 2).alias("exposure"), F.round(100 * F.col("e") / F.sum("e").over(Window.partitionBy()), 6).alias("share_pct"))


def sentinels(df: DataFrame, columns: Sequence[str], mass: float = 0.01) -> DataFrame:
    """Values that hold the mass or more of a column's rows and lie more than 1.5 interquartile ranges outside the rest of its rows."""
    long = unpivoted(df, list(columns)).withColumn("value", F.col("value").cast("double")).filter("value IS NOT NULL")
    counted = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    heavy = counted.withColumn("n", F.sum("c").over(Window.partitionBy("name"))).filter(F.col("c") >= mass * F.col("n")).select("name", F.col("value").alias("suspect"), "c", "n")
    rest = long.join(F.broadcast(heavy.select("name", "suspect")), "name").filter("value != suspect")
    q = quantiles(rest, "value", [0.25, 0.75], ["name", "suspect"])
    out = heavy.join(q, ["name", "suspect"])
    gap = 1.5 * (F.col("q")[1] - F.col("q")[0])
    return out.filter((F.col("suspect") < F.col("q")[0] - gap) | (F.col("suspect") > F.col("q")[1] + gap)).select(F.col("name").alias("column_name"), F.col("suspect").alias("value"), F.round(F.col("c") / F.col("n"), 8).alias("share"))


def row_page(panel: DataFrame, offset: int, limit: int) -> DataFrame:
    """Raw rows in order of account and month; a page has PAGE_ROWS at most."""
    return panel.orderBy("account_id", "performance_date").offset(offset).limit(min(limit, PAGE_ROWS))


#: Most rows of a page.
PAGE_ROWS = 2000


def structure_sample(panel: DataFrame, accounts: int = 3, rows: int = 4) -> DataFrame:
    """The first months of the first accounts, to show how a panel is built."""
    first = panel.select("account_id").distinct().orderBy("account_id").limit(accounts)
    nth = F.row_number().over(Window.partitionBy("account_id").orderBy("performance_date"))
    return panel.join(F.broadcast(first), "account_id", "left_semi").withColumn("_nth", nth).filter(F.col("_nth") <= rows).drop("_nth")


def account_dimension(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per account: each column's first value that isn't null."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("performance_date"))).alias(c) for c in columns]
    return panel.groupBy("account_id").agg(*first)


#: Markers of a column's unit by its name, in order of precedence; of roles, the names of the canonical panel.
UNITS = [
    ("currency", ["balance", "amount", "payment", "income", "noi", "exposure", "loss", "recovery", "committed", "drawn", "value"]),
    ("percent", ["ltv", "cltv", "utilisation", "utilization", "dti", "rollover_pct", "_pct", "rate_pct"]),
    ("count", ["count", "trades", "inquiries", "_id", "term", "months", "seq", "n_"]),
    ("score", ["score", "fico", "rating", "dscr"]),
]
IDENTIFIERS, DATES = ["account_id"], ["performance_date", "origination_date"]
OUTCOMES = ["lgd_realised", "recovery_amount", "loss_amount", "exposure_at_default", "workout_months", "terminal_event", "status", "delinquency_bucket", "delinquency_state"]


def unit_of(column: str) -> str:
    name = column.lower()
    if name.endswith(("_id", "_id_numeric")):
        return "identifier"
    if name == "interest_rate":
        return "decimal_rate"
    return next((unit for unit, marks in UNITS if any(m in name for m in marks)), "number")


def role_of(column: str, target: str = "default_flag", drivers: Sequence[str] = ()) -> str:
    for role, names in (("identifier", IDENTIFIERS), ("date", DATES), ("target", [target]), ("outcome", OUTCOMES), ("driver", drivers)):
        if column in names:
            return role
    return "other" if column.endswith(("_id", "_numeric")) else "candidate"


def column_catalogue(df: DataFrame, target: str = "default_flag", drivers: Sequence[str] = ()) -> DataFrame:
    """By column its role, unit, different values, missing share and whether it is constant."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[x for i, c in enumerate(df.columns) for x in (F.count_distinct(f"`{c}`").alias(f"u{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}"))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(role_of(c, target, drivers)).alias("role"), F.lit(unit_of(c)).alias("unit"), F.col(f"u{i}").alias("n_unique"), F.round(100 * F.col(f"m{i}") / F.col("_n"), 6).alias("missing_pct"), (F.col(f"u{i}") <= 1).alias("constant")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def cohort_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that name a cohort: by their name, or as they hold whole years from 1970 to 2049 only, 60 different ones at most."""
    whole = lambda x: F.bool_and((x == F.round(x)) & x.between(1970, 2049))
    one = df.agg(*[x for c in columns for x in (F.count_distinct(c).alias(f"u_{c}"), whole(F.expr(f"try_cast(`{c}` AS double)")).alias(f"y_{c}"))])
    named = lambda c: any(m in c.lower() for m in ("vintage", "cohort"))
    rows = [F.struct(F.lit(c).alias("column_name"), (F.lit(named(c)) | (F.coalesce(F.col(f"y_{c}"), F.lit(False)) & (F.col(f"u_{c}") <= 60))).alias("cohort_label")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def fit_window(panel: DataFrame, boundary: str, target: str = "default_flag", months: int = 12, events: int = 200) -> DataFrame:
    """What lies before a boundary: rows, months, events, and what is too little of it."""
    early = panel.filter(F.col("performance_date") < F.lit(boundary).cast("date"))
    g = early.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("performance_date").alias("months"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("events"))
    note = F.when(F.col("n") == 0, "no rows before the boundary").when(F.col("months") < months, f"less than {months} months").when(F.col("events") < events, f"less than {events} events").otherwise("enough")
    return g.withColumn("note", note)


def repeated_values(df: DataFrame, columns: Sequence[str], k: int = 6) -> DataFrame:
    """By column its k most frequent values, with their share of the rows that have one."""
    cells = unpivoted(df, list(columns)).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("name").agg(F.sum("n").alias("_all"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    # Of each name and hash range first, so that no task ranks all values of a column.
    part = F.row_number().over(Window.partitionBy("name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("n"), "value"))
    top = cells.withColumn("_part", part).filter(F.col("_part") <= k).withColumn("place", place).filter(F.col("place") <= k)
    return top.join(F.broadcast(total), "name").select(F.col("name").alias("column_name"), "place", "value", "n", F.round(F.col("n") / F.col("_all"), 8).alias("share"))


def skew_notes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column the skew of its values and of log(1 + value) (null where a value is negative), a note, and whether the logarithm helps."""
    cells = unpivoted(df, list(columns)).filter("value IS NOT NULL").groupBy("name", F.col("value").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).persist()
    own = cells.select("name", "c", "v", F.when(F.col("v") > -1, F.log1p(F.col("v"))).alias("l"), F.col("v").alias("_v"))
    ends = own.groupBy("name").agg(F.min("_v").alias("lo"), F.sum("c").alias("n"), *[(F.sum(F.col(x) * F.col("c")) / F.sum("c")).alias(f"m_{x}") for x in "vl"])
    d = own.join(F.broadcast(ends), "name")
    moment = lambda x, k: F.sum(F.pow(F.col(x) - F.col(f"m_{x}"), F.lit(k)) * F.col("c")) / F.first("n")
    m = d.groupBy("name").agg(F.first("lo").alias("lo"), *[moment(x, k).alias(f"{x}{k}") for x in "vl" for k in (2, 3)])
    skew = lambda x: F.when(F.col(f"{x}2") > 1e-18, F.col(f"{x}3") / F.pow(F.col(f"{x}2"), F.lit(1.5)))
    raw, logged = skew("v"), F.when(F.col("lo") >= 0, skew("l"))
    size = F.abs(raw)
    note = F.when(size < 0.5, "nearly symmetric").when(size < 1, "moderately skewed").when(size < 2, "strongly skewed").otherwise("extremely skewed")
    return m.select(F.col("name").alias("column_name"), F.round(raw, 6).alias("skew"), F.round(logged, 6).alias("log_skew"), note.alias("note"), F.coalesce((size >= 1) & (F.abs(logged) < size / 2), F.lit(False)).alias("log_helps"))


def severity_coverage(panel: DataFrame, severity: str = "lgd_realised", target: str = "default_flag", freq: str = "QS", least: int = 5) -> DataFrame:
    """Defaults, observed severities, and periods in which enough of them are seen or too few."""
    g = panel.filter(F.col(target) == 1).groupBy(period_of(F.col("performance_date"), freq).alias("p")).agg(F.count(F.lit(1)).alias("d"), F.count(severity).alias("o"))
    return g.agg(F.sum("d").alias("defaults"), F.sum("o").alias("observed"), F.count_if(F.col("o") >= least).alias("periods_shown"), F.count_if(F.col("o") < least).alias("periods_thin"))


def candidate_columns(df: DataFrame, target: str = "default_flag", never: Sequence[str] = ()) -> DataFrame:
    """By column whether it may be screened, and why not: identifiers, dates, outcomes, the target, refused or constant ones."""
    why = F.when(~F.col("role").isin("candidate", "driver"), F.col("role")).when(F.col("column_name").isin(*never), "refused").when(F.col("constant"), "constant")
    return column_catalogue(df, target).select("column_name", why.isNull().alias("screened"), F.coalesce(why, F.lit("")).alias("reason"))


def column_kinds(df: DataFrame, columns: Sequence[str], most: int = 12) -> DataFrame:
    """By column how it is described: as numeric if it has more different values than a category would, else as categorical."""
    own = unpivoted(df, list(columns)).filter("value IS NOT NULL").groupBy("name").agg(F.count_distinct("value").alias("n_unique"))
    return own.select(F.col("name").alias("column_name"), "n_unique", F.when(F.col("n_unique") > most, "numeric").otherwise("categorical").alias("kind"))


def content_digest(df: DataFrame) -> DataFrame:
    """One digest (12 hex digits) of a table's numeric columns: mean, deviation, least and greatest of each to six significant figures.

    It tells that data has changed, costs one aggregate, and rounding between machines doesn't alter it.
    """
    kinds = dict(df.dtypes)
    numeric = sorted(c for c in df.columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal"))
    cell = lambda c: F.coalesce(F.format_string("%.5e", c.cast("double") + 0.0), F.lit("null"))
    parts = [F.concat_ws(":", F.lit(c), *[F.when(f(F.col(c)).isNull(), "null").otherwise(cell(f(F.col(c)))) for f in (F.avg, F.stddev_samp, F.min, F.max)]) for c in numeric]
    return df.agg(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12).alias("digest"))
