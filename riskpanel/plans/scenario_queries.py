"""More panel queries with their SQL: pages and catalogues, severity, series, stored models over macro paths, stress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import binning, estimate, evaluate, losses, macro, quality, scenarios
from ..sources import panels, tape
from ..sources.panels import BOOK_SQL, MACRO_SQL, NUMERIC, book, lines, table, unpivot_sql
from .queries import AUC_OUT, LONG_SQL, LOSS, PROJ_SQL, PSI_SQL, SCORED_SQL, auc_sql, projected, query, scored


@query(f"WITH {BOOK_SQL} SELECT account_id, performance_date, default_flag, current_balance FROM book ORDER BY account_id, performance_date LIMIT 50 OFFSET 120")
def row_page(spark: SparkSession, sf: str) -> DataFrame:
    return quality.row_page(book(spark, sf).select("account_id", "performance_date", "default_flag", "current_balance"), 120, 50)


@query(f"""WITH {BOOK_SQL}, f AS (SELECT DISTINCT account_id FROM book ORDER BY 1 LIMIT 3)
SELECT account_id, performance_date, months_on_book FROM book WHERE account_id IN (SELECT account_id FROM f) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY performance_date) <= 4""")
def structure_sample(spark: SparkSession, sf: str) -> DataFrame:
    return quality.structure_sample(book(spark, sf).select("account_id", "performance_date", "months_on_book"))


DIMENSION = ["origination_date", "segment", "nation", "c_acctbal", "lgd_realised"]


@query(f"WITH {BOOK_SQL} SELECT account_id, {', '.join(f'arg_min({c}, performance_date) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in DIMENSION)} FROM book GROUP BY 1")
def account_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return quality.account_dimension(book(spark, sf), DIMENSION)


CATALOGUE = [
    ("account_id", "identifier", "identifier"), ("performance_date", "date", "number"), ("default_flag", "target", "number"), ("months_on_book", "driver", "count"), ("vintage", "candidate", "number"),
    ("origination_date", "date", "count"), ("current_balance", "candidate", "currency"), ("committed_amount", "candidate", "currency"), ("interest_rate", "candidate", "decimal_rate"), ("remaining_term", "candidate", "count"),
    ("segment", "candidate", "number"), ("lgd_realised", "outcome", "number"),
]


@query(f"WITH {BOOK_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{role}' AS role, '{unit}' AS unit, count(DISTINCT {c}) AS n_unique, round(100 * (1 - count({c}) / count(*)), 6) AS missing_pct, count(DISTINCT {c}) <= 1 AS constant FROM book" for c, role, unit in CATALOGUE))
def column_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return quality.column_catalogue(book(spark, sf).select(*[c for c, _, _ in CATALOGUE]), drivers=["months_on_book"])


@query(f"WITH {BOOK_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {'true' if role in ('candidate', 'driver') and c != 'vintage' else 'false'} AS screened, '{'' if role in ('candidate', 'driver') and c != 'vintage' else 'refused' if c == 'vintage' else role}' AS reason" for c, role, _ in CATALOGUE))
def candidate_columns(spark: SparkSession, sf: str) -> DataFrame:
    return quality.candidate_columns(book(spark, sf).select(*[c for c, _, _ in CATALOGUE]), never=["vintage"])


COHORT = ["vintage", "nation", "months_on_book", "opened", "segment"]


@query(f"""WITH {BOOK_SQL}, b AS (SELECT *, year(origination_date) AS opened FROM book) """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 60 AND coalesce(bool_and(TRY_CAST({c} AS DOUBLE) = round(TRY_CAST({c} AS DOUBLE)) AND TRY_CAST({c} AS DOUBLE) BETWEEN 1970 AND 2049), false) AS cohort_label FROM b" for c in COHORT if c != "vintage") + " UNION ALL SELECT 'vintage', true")
def cohort_labels(spark: SparkSession, sf: str) -> DataFrame:
    return quality.cohort_labels(book(spark, sf).withColumn("opened", F.year("origination_date")), COHORT)


@query(f"""WITH {BOOK_SQL}, g AS (SELECT d, count(*) FILTER (WHERE performance_date < d) AS n, count(DISTINCT performance_date) FILTER (WHERE performance_date < d) AS months, coalesce(sum(default_flag) FILTER (WHERE performance_date < d), 0)::BIGINT AS events
  FROM book, (VALUES (DATE '1980-01-01'), (DATE '1995-06-01'), (DATE '1997-01-01'), (DATE '2001-01-01')) v(d) GROUP BY 1)
SELECT d AS boundary, n, months, events, CASE WHEN n = 0 THEN 'no rows before the boundary' WHEN months < 12 THEN 'less than 12 months' WHEN events < 200 THEN 'less than 200 events' ELSE 'enough' END AS note FROM g""")
def fit_windows(spark: SparkSession, sf: str) -> DataFrame:
    b, out = book(spark, sf).select("performance_date", "default_flag"), None
    for d in ("1980-01-01", "1995-06-01", "1997-01-01", "2001-01-01"):
        own = quality.fit_window(b, d).select(F.lit(d).cast("date").alias("boundary"), "*")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {LONG_SQL}, c AS (SELECT name, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS a FROM v GROUP BY 1, 2)
SELECT name AS column_name, row_number() OVER (PARTITION BY name ORDER BY n DESC, value)::INT AS place, value, n, round(n / a, 8) AS share FROM c QUALIFY place <= 6""")
def repeated_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.repeated_values(lines(spark, sf), NUMERIC)


@query(f"""WITH {LONG_SQL}, m AS (SELECT name, min(value) AS lo, avg(value) AS a, avg(CASE WHEN value > -1 THEN ln(1 + value) END) AS b FROM v GROUP BY 1),
s AS (SELECT name, any_value(lo) AS lo, avg(pow(value - a, 2)) AS v2, avg(pow(value - a, 3)) AS v3, avg(pow(CASE WHEN value > -1 THEN ln(1 + value) END - b, 2)) AS l2, avg(pow(CASE WHEN value > -1 THEN ln(1 + value) END - b, 3)) AS l3 FROM v JOIN m USING (name) GROUP BY 1),
k AS (SELECT name, v3 / pow(v2, 1.5) AS r, CASE WHEN lo >= 0 THEN l3 / pow(l2, 1.5) END AS l FROM s)
SELECT name AS column_name, round(r, 6) AS skew, round(l, 6) AS log_skew, CASE WHEN abs(r) < 0.5 THEN 'nearly symmetric' WHEN abs(r) < 1 THEN 'moderately skewed' WHEN abs(r) < 2 THEN 'strongly skewed' ELSE 'extremely skewed' END AS note,
       coalesce(abs(r) >= 1 AND abs(l) < abs(r) / 2, false) AS log_helps FROM k""")
def skew_notes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.skew_notes(lines(spark, sf), NUMERIC)


@query(f"""WITH {BOOK_SQL}, g AS (SELECT date_trunc('quarter', performance_date) AS p, count(*) AS d, count(lgd_realised) AS o FROM book WHERE default_flag = 1 GROUP BY 1)
SELECT sum(d)::BIGINT AS defaults, sum(o)::BIGINT AS observed, count(*) FILTER (WHERE o >= 5) AS periods_shown, count(*) FILTER (WHERE o < 5) AS periods_thin FROM g""")
def severity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.severity_coverage(book(spark, sf))


@query(f"WITH {BOOK_SQL} SELECT account_id, performance_date AS month, lgd_realised AS severity FROM book WHERE default_flag = 1 AND lgd_realised IS NOT NULL")
def default_severities(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.severities(book(spark, sf))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT 'p' AS name, p AS value, CAST(date_trunc('quarter', performance_date) AS DATE) AS period, performance_date < (SELECT min(performance_date) + INTERVAL 12 MONTH FROM scored) AS base FROM scored), {PSI_SQL.format(least=200)}""")
def score_psi(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_stability(scored(spark, sf))


@query(f"""WITH {PROJ_SQL}, a AS (SELECT scenario, account_id, 1 - exp(sum(ln(1 - pd)) FILTER (WHERE t <= 12)) AS pd, avg(lgd) FILTER (WHERE t <= 12) AS lgd, greatest(max(current_balance), 1) AS w FROM proj GROUP BY 1, 2)
SELECT scenario, round(sum(pd * w) / sum(w), 8) AS pd_12, round(sum(lgd * w) / sum(w), 8) AS lgd FROM a GROUP BY 1""")
def weighted_rates(spark: SparkSession, sf: str) -> DataFrame:
    return losses.weighted_rates(projected(spark, sf))


DRIVERS = ["months_on_book", "remaining_term", "current_balance", "committed_amount", "c_acctbal"]


@query(f"""WITH {BOOK_SQL} SELECT * FROM ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM book" for i, a in enumerate(DRIVERS) for b in DRIVERS[i + 1 :])}) WHERE abs(r) >= 0.9""")
def high_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return binning.correlations(book(spark, sf), DRIVERS).filter(F.abs("r") >= 0.9)


@query(f"WITH {MACRO_SQL} SELECT key, month, round(100 * (pow(value / nullif(lag(value, 3) OVER (PARTITION BY key ORDER BY month), 0), 4) - 1), 5) AS value FROM macro")
def trailing_growth(spark: SparkSession, sf: str) -> DataFrame:
    return macro.trailing_growth(panels.macro(spark, sf)).withColumn("value", F.round("value", 5))


@query(f"""WITH {MACRO_SQL}, q AS (SELECT key, CAST(date_trunc('quarter', month) AS DATE) AS period, round(avg(value), 6) AS v FROM macro WHERE key = 'ticket' GROUP BY 1, 2), g AS (SELECT key, period, 100 * (v / lag(v, 4) OVER (PARTITION BY key ORDER BY period) - 1) AS g FROM q)
SELECT key, period, round(100 * exp(sum(ln(1 + g / 100)) OVER (PARTITION BY key, quarter(period) ORDER BY period)), 5) AS value FROM g WHERE g IS NOT NULL""")
def level_from_yoy(spark: SparkSession, sf: str) -> DataFrame:
    q = macro.down(panels.macro(spark, sf).filter("key = 'ticket'"), "avg").drop("n")
    lag = F.expr("lag(value, 4) OVER (PARTITION BY key ORDER BY period)")
    growth = q.withColumn("value", 100 * (F.col("value") / lag - 1)).filter("value IS NOT NULL")
    return macro.level_from_yoy(growth).withColumn("value", F.round("value", 5))


@query(f"WITH {MACRO_SQL} SELECT key, month, round(value, 6) AS value FROM macro WHERE key IN ('sales', 'ticket') AND month BETWEEN DATE '1996-03-01' AND DATE '1999-06-01'")
def macro_slice(spark: SparkSession, sf: str) -> DataFrame:
    return macro.panel_slice(panels.macro(spark, sf), ["sales", "ticket"], "1996-03-01", "1999-06-01").withColumn("value", F.round("value", 6))


@query(f"""WITH {MACRO_SQL}, m AS (SELECT key, month, CASE WHEN month(month) IN (1, 5, 6) THEN NULL ELSE value END AS v FROM macro)
SELECT key, month, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM m""")
def filled_series(spark: SparkSession, sf: str) -> DataFrame:
    m = panels.macro(spark, sf).withColumn("value", F.when(~F.month("month").isin(1, 5, 6), F.col("value")))
    return macro.filled(m).withColumn("value", F.round("value", 6))


@query(f"""WITH {MACRO_SQL}, s AS (SELECT key, avg(value) AS a, stddev_pop(value) AS d FROM macro WHERE month <= DATE '1998-12-01' GROUP BY 1) SELECT key, month, round((value - a) / nullif(d, 0), 7) AS value FROM macro JOIN s USING (key)""")
def standardized_series(spark: SparkSession, sf: str) -> DataFrame:
    return macro.standardized(panels.macro(spark, sf), "1998-12-01").withColumn("value", F.round("value", 7))


@query(f"WITH {MACRO_SQL}, q AS (SELECT DISTINCT key, date_trunc('quarter', month) AS p FROM macro) SELECT key, count(*) AS periods, true AS identity_holds FROM q GROUP BY 1")
def benchmark_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmarked months add up to the quarters that they were made from: the SQL says so of every series."""
    quarters = macro.down(panels.macro(spark, sf), "avg").select("key", "period", "value")
    return macro.aggregation_residual(macro.benchmarked(quarters, "avg"), quarters, "avg")


@query("""SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type AS key, round(sum(value), 6) AS value FROM events GROUP BY 1, 2""")
def daily_to_monthly(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("month")).agg(F.sum("value").alias("value"))
    return macro.to_monthly(days, "D", "sum").withColumn("value", F.round("value", 6))


@query(f"""WITH {MACRO_SQL}, d AS (SELECT 'all' AS scenario, month, round(value, 6) AS sales FROM macro WHERE key = 'sales' AND month < DATE '2000-01-01'), i AS (SELECT 'all' AS scenario, month, round(value, 6) AS ticket FROM macro WHERE key = 'ticket' AND month >= DATE '1999-06-01')
SELECT coalesce(d.scenario, i.scenario) AS scenario, coalesce(d.month, i.month) AS month, sales, ticket FROM d FULL JOIN i ON d.month = i.month""")
def joined_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    m = panels.macro(spark, sf)
    own = lambda key, when: m.filter(f"key = '{key}' AND {when}").select(F.lit("all").alias("scenario"), "month", F.round("value", 6).alias(key))
    return scenarios.joined_scenarios(own("sales", "month < DATE'2000-01-01'"), own("ticket", "month >= DATE'1999-06-01'"))


@query("""SELECT c_custkey AS k, round(ln(greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, (c_custkey % 101) / 100.0::DOUBLE)) / (1 - greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, (c_custkey % 101) / 100.0::DOUBLE)))), 8) AS logit,
  round(1 / (1 + exp(-greatest(-35.0::DOUBLE, least(35.0::DOUBLE, (c_custkey % 41 - 20) * 3.0::DOUBLE)))), 12) AS pd, round(1 - pow(1 - (c_custkey % 50) / 100.0::DOUBLE, 1 / 12.0::DOUBLE), 10) AS monthly,
  CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 10 <> 1 THEN c_custkey::DOUBLE END AS finite, round(c_acctbal + 0.19::DOUBLE * greatest(c_custkey - c_acctbal, 0), 4) AS exposure, CASE c_custkey % 3 WHEN 0 THEN 'gdp' WHEN 1 THEN 'house' ELSE 'rate' END AS family FROM customer""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.when(k % 10 == 0, F.lit(float("inf"))).when(k % 10 == 1, F.lit(float("nan"))).otherwise(k.cast("double"))
    key = F.when(k % 3 == 0, "gdp_growth").when(k % 3 == 1, "house_yoy").otherwise("rate")
    return table(spark, sf, "customer").select(
        k.alias("k"), F.round(exprs.logit((k % 101) / F.lit(100.0)), 8).alias("logit"), F.round(exprs.sigmoid((k % 41 - 20) * F.lit(3.0)), 12).alias("pd"), F.round(exprs.deannualize((k % 50).cast("double")), 10).alias("monthly"),
        exprs.finite(value).alias("finite"), F.round(exprs.ccf_exposure(F.col("c_acctbal"), k, 0.19), 4).alias("exposure"), exprs.macro_family(key).alias("family"),
    )


@query(f"""WITH {MACRO_SQL} SELECT key || '@' || t || '@' || lag AS candidate, key, t AS transform, lag::INT AS lag FROM (SELECT DISTINCT key FROM macro), (SELECT unnest(['level', 'yoy']) AS t), (SELECT unnest([0, 12]) AS lag)""")
def candidate_names(spark: SparkSession, sf: str) -> DataFrame:
    made = macro.lagged(macro.transformed(panels.macro(spark, sf), ["level", "yoy"]), [0, 12]).select("candidate").distinct()
    return macro.decoded(made)


@query("""SELECT 'L' || (o_orderkey - o_orderkey % 7) AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS performance_date, CASE WHEN o_orderkey % 50 = 1 THEN 0 WHEN o_orderkey % 31 = 0 THEN 2 ELSE (o_orderstatus = 'F')::INT END::TINYINT AS default_flag,
  o_totalprice AS current_balance, greatest(0, least(1, (o_orderkey % 13 - 3) / 8.0::DOUBLE)) AS lgd_realised, greatest(0, 12 * (year(o_orderdate) - 1996) + month(o_orderdate) - 1)::INT AS months_on_book FROM orders WHERE o_orderkey % 97 <> 0""")
def tape_panel(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = table(spark, sf, "orders").select(
        F.concat(F.lit("L"), (k - k % 7).cast("string")).alias("account_id"), F.when(k % 97 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("performance_date"),
        F.when(k % 50 == 1, F.lit(None)).when(k % 31 == 0, "2").otherwise((F.col("o_orderstatus") == "F").cast("int").cast("string")).alias("default_flag"), F.col("o_totalprice").alias("current_balance"),
        ((k % 13 - 3) / F.lit(8.0)).cast("string").alias("lgd_realised"), F.lit("1996-01-15").alias("origination_date"),
    )
    return tape.panel_of(own).withColumn("months_on_book", F.col("months_on_book").cast("int")).drop("origination_date")


# Stored models, whose coefficients are fixed, over macro paths.
AS_OF, HORIZON, TERM = "1999-12-01", 24, "ticket@yoy@3"
PATHS = {"base": 1.0, "severe": 0.8}
WEIGHTS = {"base": 0.7, "severe": 0.3}
PD_MODEL = estimate.Model(
    ["(intercept)", "months_on_book", "segment", TERM], [-4.5, 0.3, 1.0, -0.4], [0.1] * 4, 0.0, 0,
    [estimate.Term("months_on_book", "scaled", mean=30.0, sd=20.0, missing=30.0), estimate.Term("segment", "woe_levels", levels={"BUILDING": 0.2, "MACHINERY": -0.1, "Other": 0.05}), estimate.Term(TERM, "scaled", mean=0.0, sd=5.0, missing=0.0)],
)
LGD_MODEL = estimate.Model(["(intercept)", "current_balance"], [-0.5, 0.2], [0.1] * 2, 0.0, 0, [estimate.Term("current_balance", "scaled", mean=300_000.0, sd=200_000.0, missing=300_000.0)])


def macro_terms(spark: SparkSession, sf: str) -> DataFrame:
    """TERM by scenario and month, on history spliced to each path."""
    m = panels.macro(spark, sf).filter("key = 'ticket'")
    factor = F.create_map(*[F.lit(x) for kv in PATHS.items() for x in kv])
    again = m.filter("month >= DATE'1998-01-01' AND month < DATE'2000-01-01'").select(F.explode(F.array(*map(F.lit, PATHS))).alias("scenario"), "key", F.add_months("month", 24).alias("month"), "value")
    paths = again.withColumn("value", F.col("value") * factor[F.col("scenario")])
    return scenarios.term_columns(scenarios.scenario_paths(m, paths), [("ticket", "yoy", 3)], ["scenario"])


TERM_SQL = f"""{MACRO_SQL}, th AS (SELECT month, value FROM macro WHERE key = 'ticket' AND month < DATE '2000-01-01'), sc AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PATHS.items())}) v(scenario, f)),
sp AS (SELECT scenario, month, value FROM th, sc UNION ALL SELECT scenario, CAST(month + INTERVAL 24 MONTH AS DATE), value * f FROM th, sc WHERE month >= DATE '1998-01-01'),
tx AS (SELECT scenario, CAST(month + INTERVAL 3 MONTH AS DATE) AS month, 100 * (value / nullif(lag(value, 12) OVER (PARTITION BY scenario ORDER BY month), 0) - 1) AS x FROM sp),
tr AS (SELECT scenario, min(x) FILTER (WHERE month BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}') AS lo, max(x) FILTER (WHERE month BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}') AS hi FROM tx GROUP BY 1)"""
RUN_SQL = f"""{TERM_SQL}, {BOOK_SQL.strip()}, tz AS (SELECT scenario, capped, date_diff('month', DATE '{AS_OF}', month) AS t, CASE WHEN capped AND x IS NOT NULL THEN greatest(coalesce(lo, x), least(coalesce(hi, x), x)) ELSE x END AS x
  FROM tx JOIN tr USING (scenario), (VALUES (false), (true)) c(capped) WHERE month > DATE '{AS_OF}'),
ex AS (SELECT b.*, tz.*, interest_rate / 12 AS r FROM book b, tz WHERE performance_date = DATE '{AS_OF}' AND default_flag = 0 AND t <= {HORIZON}),
p0 AS (SELECT scenario, capped, account_id, t, current_balance, 1 / (1 + exp(-(-4.5::DOUBLE + 0.3::DOUBLE * (months_on_book + t - 30) / 20 + CASE WHEN segment IS NULL THEN 0 WHEN segment = 'BUILDING' THEN 0.2::DOUBLE WHEN segment = 'MACHINERY' THEN -0.1::DOUBLE ELSE 0.05::DOUBLE END - 0.4::DOUBLE * coalesce(x, 0) / 5))) AS pd,
  1 / (1 + exp(-(-0.5::DOUBLE + 0.2::DOUBLE * (current_balance - 300000) / 200000))) AS lgd, CASE WHEN t >= remaining_term THEN 0 ELSE greatest(0, current_balance * pow(1 + r, t) - current_balance * r / (1 - pow(1 + r, -remaining_term)) * (pow(1 + r, t) - 1) / r) END AS ead, pow(1 + r, -t) AS df FROM ex),
proj AS (SELECT *, coalesce(exp(sum(ln(1 - pd)) OVER (PARTITION BY scenario, capped, account_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS survival FROM p0)"""


@query(f"""WITH {RUN_SQL}, l AS (SELECT scenario, capped, round(sum({LOSS}), 4) AS ecl, round(sum(current_balance) FILTER (WHERE t = 1), 2) AS exposure FROM proj GROUP BY 1, 2)
SELECT scenario, capped, ecl, exposure FROM l UNION ALL SELECT 'weighted', capped, round(sum(ecl * CASE scenario WHEN 'base' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 4), max(exposure) FROM l GROUP BY capped""")
def project_fitted_model(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of stored default and severity models by macro scenario, with paths as given and capped to the fitted range, and weighted."""
    open_book, terms = scenarios.as_of_book(book(spark, sf), AS_OF), macro_terms(spark, sf)
    out = None
    for capped in (False, True):
        path = scenarios.winsorized(terms, [TERM], AS_OF, "1996-01-01") if capped else terms
        own = losses.losses(scenarios.projected(open_book, AS_OF, PD_MODEL, LGD_MODEL, path, HORIZON)).withColumn("capped", F.lit(capped))
        out = own if out is None else out.unionByName(own)
    return scenarios.weighted(out, WEIGHTS, "capped")


@query(f"""WITH {RUN_SQL} SELECT scenario, t::INT AS t, round(avg(pd), 9) AS pd, round(avg(survival), 9) AS survival, round(sum({LOSS}), 4) AS loss FROM proj WHERE NOT capped GROUP BY 1, 2""")
def fitted_model_by_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = scenarios.projected(scenarios.as_of_book(book(spark, sf), AS_OF), AS_OF, PD_MODEL, LGD_MODEL, macro_terms(spark, sf), HORIZON)
    return rows.groupBy("scenario", "t").agg(F.round(F.avg("pd"), 9).alias("pd"), F.round(F.avg("survival"), 9).alias("survival"), F.round(F.sum(losses.loss()), 4).alias("loss"))


@query(f"""WITH {TERM_SQL}, s AS (SELECT scenario, month, -0.08::DOUBLE * (x - max(CASE WHEN month = DATE '{AS_OF}' THEN x END) OVER (PARTITION BY scenario)) AS d FROM tx),
p AS (SELECT scenario, max(d) AS peak, arg_max(month, d) AS peak_month FROM s WHERE month > DATE '{AS_OF}' GROUP BY 1), o AS (SELECT *, CASE scenario WHEN 'base' THEN 0 ELSE 1 END::INT AS place FROM p)
SELECT scenario, place, round(peak, 6) AS peak, peak_month, coalesce(peak >= lag(peak) OVER (ORDER BY place) - 1e-12, true) AS monotone FROM o""")
def stress_from_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.stress_from_coefficients(macro_terms(spark, sf), {TERM: -0.08}, AS_OF, list(PATHS))


@query(f"""WITH {TERM_SQL}, b AS (SELECT scenario, abs(x - 2 * lag(x) OVER w + lag(x, 2) OVER w) AS b FROM tx WINDOW w AS (PARTITION BY scenario ORDER BY month)) SELECT scenario, round(max(b), 6) AS roughness FROM b GROUP BY 1""")
def path_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.smoothness(macro_terms(spark, sf), TERM)


@query(f"""WITH {TERM_SQL}, {BOOK_SQL.strip()} SELECT b.performance_date AS period, count(*) AS n, round(any_value(x), 6) AS ticket FROM book b LEFT JOIN (SELECT month, x FROM tx WHERE scenario = 'base' AND month <= DATE '2000-03-01') t ON t.month = b.performance_date WHERE b.performance_date <= DATE '2000-03-01' GROUP BY 1""")
def macro_joined_panel(spark: SparkSession, sf: str) -> DataFrame:
    joined = scenarios.with_terms(book(spark, sf), panels.macro(spark, sf), [("ticket", "yoy", 3)]).filter("performance_date <= DATE'2000-03-01'")
    return joined.groupBy(F.col("performance_date").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(TERM), 6).alias("ticket"))


@query()
def fit_macro_model(spark: SparkSession, sf: str) -> DataFrame:
    """A default model with a macro term of the panel's months."""
    train = scenarios.with_terms(book(spark, sf), panels.macro(spark, sf), [("ticket", "yoy", 3)]).filter("performance_date < DATE'2000-01-01'")
    model = estimate.fit_logistic(train, "default_flag", {"months_on_book": "scaled", "segment": "woe_levels", TERM: "scaled"})
    checks = {n: v for n, _, _, v in scenarios.sign_checks(dict(zip(model.names, model.beta, strict=True)), {TERM: -1, "segment": 1})}
    rows = [(n, round(float(b), 6), round(float(s), 6), checks[n]) for n, b, s, *_ in model.table()]
    return spark.createDataFrame(rows, "term string, beta double, se double, sign string")


DESIGN = ["1.0::DOUBLE", "(months_on_book - 30) / 20.0::DOUBLE", "current_balance / 100000.0::DOUBLE"]
BETA = [-4.5, 0.3, 0.1]


def _step_sql() -> str:
    eta = " + ".join(f"({b}::DOUBLE) * x{i}" for i, b in enumerate(BETA))
    cells = [(f"h{i}{j}", f"sum(x{i} * x{j} * p * (1 - p))") for i in range(3) for j in range(i, 3)] + [(f"g{i}", f"sum(x{i} * (y - p))") for i in range(3)]
    cells += [("likelihood", "sum(y * ln(p) + (1 - y) * ln(1 - p))")]
    return f"""WITH {BOOK_SQL}, d AS (SELECT {", ".join(f"{x} AS x{i}" for i, x in enumerate(DESIGN))}, default_flag AS y FROM book), s AS (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM d)
""" + " UNION ALL ".join(f"SELECT '{n}' AS cell, round({v}, 5) AS value FROM s" for n, v in cells)


@query(_step_sql())
def newton_step(spark: SparkSession, sf: str) -> DataFrame:
    """The Gram matrix, gradient and likelihood of one Newton step at fixed coefficients."""
    terms = [estimate.Term("months_on_book", "scaled", mean=30.0, sd=20.0), estimate.Term("current_balance", "scaled", mean=0.0, sd=100_000.0)]
    rows, _ = estimate.design(book(spark, sf), terms, F.col("default_flag").cast("double").alias("y"))
    h, g, ll, _, _ = estimate.sums(rows, BETA)
    found = [(f"h{i}{j}", float(h[i, j])) for i in range(3) for j in range(i, 3)] + [(f"g{i}", float(v)) for i, v in enumerate(g)] + [("likelihood", ll)]
    return spark.createDataFrame(found, "cell string, value double").withColumn("value", F.round("value", 5))


STORED_SQL = f"""{BOOK_SQL}, scored AS (SELECT CASE WHEN performance_date >= DATE '2000-01-01' THEN 'out_of_time' ELSE 'in_time' END AS slice, default_flag AS y, round(1 / (1 + exp(-(-4.5::DOUBLE + 0.3::DOUBLE * (months_on_book - 30) / 20
  + CASE WHEN segment IS NULL THEN 0 WHEN segment = 'BUILDING' THEN 0.2::DOUBLE WHEN segment = 'MACHINERY' THEN -0.1::DOUBLE ELSE 0.05::DOUBLE END))), 12) AS p FROM book)"""


@query(f"WITH {STORED_SQL}, {auc_sql('slice')} SELECT slice, {AUC_OUT}")
def stored_model_slices(spark: SparkSession, sf: str) -> DataFrame:
    model = estimate.Model(PD_MODEL.names[:3], PD_MODEL.beta[:3], PD_MODEL.se[:3], 0.0, 0, PD_MODEL.terms[:2])
    late = F.col("performance_date") >= F.lit("2000-01-01").cast("date")
    rows = book(spark, sf).select(F.when(late, "out_of_time").otherwise("in_time").alias("slice"), F.col("default_flag").alias("y"), F.round(model.score(), 12).alias("p"))
    return evaluate.discrimination(rows, ["slice"])


@query(f"""WITH {BOOK_SQL}, v AS (SELECT * FROM ({unpivot_sql("book", ["months_on_book", "nation"], "account_id")}) WHERE value IS NOT NULL) SELECT name AS column_name, count(DISTINCT value) AS n_unique, CASE WHEN count(DISTINCT value) > 12 THEN 'numeric' ELSE 'categorical' END AS kind FROM v GROUP BY 1""")
def univariate_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return quality.column_kinds(book(spark, sf), ["months_on_book", "nation"])


TORNADO_SQL = RUN_SQL.replace("tx AS (SELECT scenario", "tx0 AS (SELECT scenario").replace("tr AS (SELECT", f"""sdv AS (SELECT stddev_pop(x) AS sd FROM tx0 WHERE scenario = 'base' AND month BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}'),
tx AS (SELECT scenario, month, x FROM tx0 WHERE scenario = 'base' UNION ALL SELECT '{TERM}', month, CASE WHEN month > DATE '{AS_OF}' THEN x - sd ELSE x END FROM tx0, sdv WHERE scenario = 'base'),
tr AS (SELECT""")


@query(f"""WITH {TORNADO_SQL}, l AS (SELECT scenario, sum({LOSS}) AS ecl FROM proj WHERE NOT capped GROUP BY 1)
SELECT a.scenario AS term, round(sd, 6) AS sd, round(b.ecl, 2) AS base_ecl, round(a.ecl, 2) AS shocked_ecl, round(a.ecl - b.ecl, 2) AS change, 1::INT AS place FROM l a, l b, sdv WHERE a.scenario <> 'base' AND b.scenario = 'base'""")
def macro_tornado(spark: SparkSession, sf: str) -> DataFrame:
    """One deviation of each macro term, the adverse way, projected."""
    found = scenarios.macro_tornado(scenarios.as_of_book(book(spark, sf), AS_OF), AS_OF, PD_MODEL, LGD_MODEL, macro_terms(spark, sf), HORIZON, "1996-01-01")
    return found.select("term", "place", *[F.round(c, d).alias(c) for c, d in (("sd", 6), ("base_ecl", 2), ("shocked_ecl", 2), ("change", 2))])
