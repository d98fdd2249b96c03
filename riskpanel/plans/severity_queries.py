"""Queries of the severity operators, of shapes and forms of drivers, and of the search, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, curves, estimate, forms, knots, quality, scenarios, severity
from ..sources import panels
from ..sources.panels import BOOK_SQL, LINES_SQL, NUMERIC, book, lines, unpivot_sql
from . import search, severity_search
from .queries import NUMERIC_WOE, query

NUMERIC_DRIVERS = ["current_balance", "committed_amount", "months_on_book", "c_acctbal"]
LEVEL_DRIVERS = ["segment", "origination_date"]


@query(f"""WITH {BOOK_SQL}, d AS (SELECT {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in NUMERIC_DRIVERS + LEVEL_DRIVERS)} FROM book WHERE default_flag = 1), l AS ({unpivot_sql("d", NUMERIC_DRIVERS + LEVEL_DRIVERS, "1 AS k")}),
g AS (SELECT name, round(count(value) / count(*), 8) AS filled, count(DISTINCT value) AS levels, CASE WHEN name IN ({", ".join(f"'{c}'" for c in NUMERIC_DRIVERS)}) THEN 'numeric' ELSE 'categorical' END AS kind FROM l GROUP BY 1)
SELECT name AS column_name, kind, filled, levels, CASE kind WHEN 'numeric' THEN filled >= 0.5 AND levels >= 3 ELSE levels BETWEEN 2 AND 12 END AS offered FROM g""")
def severity_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return severity.candidates(book(spark, sf).filter("default_flag = 1"), NUMERIC_DRIVERS, LEVEL_DRIVERS)


SEEN_SQL = f"{LINES_SQL}, seen AS (SELECT * REPLACE (greatest(0, least(1, lgd_realised)) AS lgd_realised) FROM lines WHERE y = 1 AND lgd_realised IS NOT NULL)"
RANKED, LEVELLED = ["price", "size", "retail"], ["priority", "segment"]


def seen_lines(spark: SparkSession, sf: str) -> DataFrame:
    return severity.observed(lines(spark, sf), target="y")


def quantile_bins_sql(columns: list[str], n: int) -> str:
    cuts = ", ".join(f"{i / n}" for i in range(1, n))
    return f"""v AS (SELECT * FROM ({unpivot_sql("seen", columns, "lgd_realised AS s")}) WHERE value IS NOT NULL), e AS (SELECT name, list_distinct(quantile_cont(value, [{cuts}])) AS e FROM v GROUP BY 1),
b AS (SELECT v.*, list_sort(e) AS e, len(list_filter(e, lambda x: x <= value))::INT AS bin FROM v JOIN e USING (name))"""


@query(f"""WITH {SEEN_SQL}, {quantile_bins_sql(RANKED, 12)}, c AS (SELECT name, bin, avg(s) AS m FROM b GROUP BY 1, 2 HAVING count(*) >= 30), n AS (SELECT name, max(m) - min(m) AS spread, count(*) AS buckets FROM c GROUP BY 1),
r AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY name ORDER BY s) + (count(*) OVER (PARTITION BY name, s) - 1) / 2 AS ry FROM v),
rho AS (SELECT name, corr(rx, ry) AS rho FROM r GROUP BY 1), lv AS ({unpivot_sql("seen", LEVELLED, "lgd_realised AS s")}), lm AS (SELECT name, coalesce(value, 'Missing') AS level, avg(s) AS m FROM lv GROUP BY 1, 2)
SELECT name AS column_name, round(rho, 7) AS spearman, round(spread, 8) AS spread, buckets FROM n JOIN rho USING (name)
UNION ALL SELECT name, NULL, round(max(m) - min(m), 8), count(*) FROM lm GROUP BY 1""")
def severity_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return severity.ranking(seen_lines(spark, sf), RANKED, LEVELLED)


QLL = "({s} * ln({m}) + ({n} - {s}) * ln(1 - ({m})))"


@query(f"""WITH {SEEN_SQL}, {quantile_bins_sql(["price", "retail"], 5)}, g AS (SELECT name, bin, count(*) AS n, sum(s) AS s, avg(s) AS m, stddev_samp(s) AS d, any_value(CASE WHEN bin > 0 THEN e[bin] END) AS lo FROM b GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER p AS tn, sum(s) OVER p / sum(n) OVER p AS bm, sum({QLL.format(s="s", n="n", m="m")}) OVER p AS ll, sum(s) OVER p AS ts FROM g WINDOW p AS (PARTITION BY name))
SELECT name AS column_name, bin, lo, n, round(n / tn, 8) AS share, round(m, 8) AS mean, round(d / sqrt(n), 8) AS se, round(ln(m / (1 - m)) - ln(bm / (1 - bm)), 7) AS weight, round(1 - ll / {QLL.format(s="ts", n="tn", m="bm")}, 7) AS deviance_r2 FROM t""")
def severity_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of two drivers; with rows as these no bin is thin, so the SQL merges none (a test does)."""
    return severity.bins(seen_lines(spark, sf), ["price", "retail"])


#: A stored severity model of the lines.
STORED = estimate.Model(["(intercept)", "price", "size"], [-0.1, 0.2, -0.05], [0.1] * 3, 0.0, 0, [estimate.Term("price", "scaled", mean=30_000.0, sd=20_000.0, missing=30_000.0), estimate.Term("size", "scaled", mean=25.0, sd=15.0, missing=25.0)])


def stored_sql(price: str = "price", size: str = "size") -> str:
    return f"1 / (1 + exp(-(-0.1::DOUBLE + 0.2::DOUBLE * (coalesce({price}, 30000) - 30000) / 20000 - 0.05::DOUBLE * (coalesce({size}, 25) - 25) / 15)))"


FITTED_SQL = f"{SEEN_SQL}, m AS (SELECT year(performance_date)::INT AS year, performance_date, lgd_realised AS a, {stored_sql()} AS p FROM seen)"


def stored_scores(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return severity.scored(seen_lines(spark, sf), STORED, *keep)


@query(f"""WITH {FITTED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY year, round(p, 12)) - 1) / 2 AS rp, rank() OVER (PARTITION BY year ORDER BY a) + (count(*) OVER (PARTITION BY year, a) - 1) / 2 AS ra FROM m),
g AS (SELECT year, count(*) AS n, sum(a) AS s, avg(a) AS ma, avg(p) AS mp, avg(abs(a - p)) AS mae, sqrt(avg(pow(a - p, 2))) AS rmse, sum(a * ln(p) + (1 - a) * ln(1 - p)) AS ll, corr(rp, ra) AS rho FROM r GROUP BY 1)
SELECT year, n, round(ma, 8) AS mean_actual, round(mp, 8) AS mean_predicted, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(CASE WHEN n > 1 THEN 1 - ll / {QLL.format(s="s", n="n", m="ma")} END, 7) AS deviance_r2, round(rho, 7) AS spearman FROM g""")
def severity_measures(spark: SparkSession, sf: str) -> DataFrame:
    rows = severity.scored(seen_lines(spark, sf).withColumn("year", F.year("performance_date")), STORED, "year")
    return severity.measures(rows, ["year"])


def cohorts_sql(n: int) -> str:
    cuts = ", ".join(f"{i / n}" for i in range(1, n))
    return f"q AS (SELECT list_distinct(quantile_cont(round(p, 12), [{cuts}])) AS e FROM m), c AS (SELECT *, len(list_filter(e, lambda x: x <= round(p, 12)))::INT AS bin FROM m, q)"


@query(f"""WITH {FITTED_SQL}, {cohorts_sql(10)}, t AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(a) AS a, 1.96 * stddev_samp(a) / sqrt(count(*)) AS h, avg((a <= 1e-9)::INT) AS z, avg((a >= 1 - 1e-9)::INT) AS t FROM c GROUP BY 1)
SELECT bin + 1 AS cohort, n, round(p, 8) AS predicted, round(a, 8) AS actual, round(greatest(0, a - h), 8) AS low, round(least(1, a + h), 8) AS high, round(z, 8) AS zero_share, round(t, 8) AS total_share FROM t""")
def severity_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return severity.calibration(stored_scores(spark, sf))


@query(f"""WITH {FITTED_SQL}, {cohorts_sql(20)}, t AS (SELECT bin, count(*) AS n, avg(p) AS p, avg((a - p) / sqrt(p * (1 - p))) AS r, coalesce(1.96 * stddev_samp((a - p) / sqrt(p * (1 - p))) / sqrt(count(*)), 0) AS h FROM c GROUP BY 1)
SELECT bin, n, round(p, 7) AS predicted, round(r, 7) AS residual, round(r - h, 7) AS low, round(r + h, 7) AS high FROM t""")
def severity_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return severity.residual_curve(stored_scores(spark, sf))


@query(f"""WITH {FITTED_SQL}, t AS (SELECT CAST(date_trunc('year', performance_date) AS DATE) AS period, count(*) AS n, avg(a) AS a, avg(p) AS p, coalesce(1.96 * stddev_samp(a) / sqrt(count(*)), 0) AS h FROM m GROUP BY 1 HAVING count(*) >= 5)
SELECT period, n, round(a, 8) AS actual, round(p, 8) AS predicted, round(a - h, 8) AS low, round(a + h, 8) AS high, period < DATE '1997-01-01' AS in_sample FROM t""")
def severity_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return severity.by_year(stored_scores(spark, sf, "performance_date"), "1997-01-01")


@query(f"""WITH {SEEN_SQL}, d AS (SELECT stddev_samp(price) AS dp, stddev_samp(size) AS dz FROM seen)
SELECT 'price' AS driver, round(any_value(dp), 6) AS sd, round(avg({stored_sql()}), 8) AS base, round(avg({stored_sql("(price + dp)")}), 8) AS up, round(avg({stored_sql("(price - dp)")}), 8) AS down FROM seen, d
UNION ALL SELECT 'size', round(any_value(dz), 6), round(avg({stored_sql()}), 8), round(avg({stored_sql(size="(size + dz)")}), 8), round(avg({stored_sql(size="(size - dz)")}), 8) FROM seen, d""")
def severity_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return severity.sensitivity(seen_lines(spark, sf), STORED, ["price", "size"])


@query(f"""WITH {BOOK_SQL} SELECT round(avg(0.45::DOUBLE), 8) AS severity, round(sum(0.45::DOUBLE * current_balance), 2) AS loss FROM book WHERE default_flag = 1""")
def assumed_severity(spark: SparkSession, sf: str) -> DataFrame:
    p = severity.assumed(0.45).score()
    return book(spark, sf).filter("default_flag = 1").agg(F.round(F.avg(p), 8).alias("severity"), F.round(F.sum(p * F.col("current_balance")), 2).alias("loss"))


@query()
def severity_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted before the boundary, measured before and after it."""
    return severity.backtest(lines(spark, sf), {"price": "scaled", "size": "scaled"}, "1997-01-01", target="y")


@query()
def severity_link_test(spark: SparkSession, sf: str) -> DataFrame:
    found = severity.link_test(stored_scores(spark, sf))
    return spark.createDataFrame([tuple(None if v is None else round(v, 6) for v in found)], "coefficient double, z double, p_value double")


@query(f"""WITH {NUMERIC_WOE}, s0 AS (SELECT w.name, bin, n, rate, woe AS y, CASE WHEN len(e) = 0 THEN 0 WHEN bin = 0 THEN e[1] WHEN bin = len(e) THEN e[len(e)] ELSE (e[bin] + e[bin + 1]) / 2 END AS x0 FROM w JOIN (SELECT name, list_sort(e) AS e FROM q) USING (name) WHERE bin >= 0 AND n > 0),
s1 AS (SELECT name, rate, n / sum(n) OVER p AS w, y, (x0 - avg(x0) OVER p) / coalesce(nullif(stddev_pop(x0) OVER p, 0), 1) AS x, rate - lag(rate) OVER (PARTITION BY name ORDER BY bin) AS step FROM s0 WINDOW p AS (PARTITION BY name)),
s2 AS (SELECT *, y - sum(w * y) OVER p AS yc, x - sum(w * x) OVER p AS z1, x * x - sum(w * x * x) OVER p AS c2, x * x * x - sum(w * x * x * x) OVER p AS c3 FROM s1 WINDOW p AS (PARTITION BY name)),
s3 AS (SELECT *, c2 - z1 * sum(w * c2 * z1) OVER p / nullif(sum(w * z1 * z1) OVER p, 0) AS z2 FROM s2 WINDOW p AS (PARTITION BY name)),
s4 AS (SELECT *, c3 - z1 * sum(w * c3 * z1) OVER p / nullif(sum(w * z1 * z1) OVER p, 0) - z2 * sum(w * c3 * z2) OVER p / nullif(sum(w * z2 * z2) OVER p, 0) AS z3 FROM s3 WINDOW p AS (PARTITION BY name)),
s5 AS (SELECT name, count(*) AS bins, max(yc) - min(yc) AS spread, coalesce(bool_and(step >= 0), true) OR coalesce(bool_and(step <= 0), true) AS monotone, {", ".join(f"coalesce(pow(sum(w * z{d} * yc), 2) / nullif(sum(w * z{d} * z{d}) * sum(w * yc * yc), 0), 0) AS g{d}" for d in (1, 2, 3))} FROM s4 GROUP BY 1),
s6 AS (SELECT *, g1 + g2 + CASE WHEN bins >= 5 THEN g3 ELSE 0 END AS smooth FROM s5),
s7 AS (SELECT *, CASE WHEN bins < 4 THEN 'woe' WHEN spread < 1e-8 THEN 'continuous' WHEN NOT monotone THEN CASE WHEN smooth >= 0.75 THEN 'spline' ELSE 'bins' END WHEN g1 >= 0.95 THEN 'continuous' WHEN g2 >= 0.03 THEN 'spline' ELSE 'woe' END AS treatment FROM s6)
SELECT name AS column_name, bins, monotone, CASE WHEN bins >= 4 THEN round(CASE WHEN spread < 1e-8 THEN 0 ELSE g1 END, 6) END AS linear_r2, CASE WHEN bins >= 4 THEN round(CASE WHEN spread < 1e-8 THEN 0 ELSE smooth END, 6) END AS smooth_r2,
       CASE WHEN bins >= 4 THEN round(CASE WHEN spread < 1e-8 THEN 0 ELSE g2 END, 6) END AS curvature, treatment, CASE WHEN bins < 4 OR spread < 1e-8 THEN 'low' WHEN treatment = 'woe' THEN 'medium' ELSE 'high' END AS confidence FROM s7""")
def shape_diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    return forms.shapes(lines(spark, sf), NUMERIC, "y")


@query()
def form_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return forms.recommendation(book(spark, sf), "months_on_book", "default_flag")


@query()
def column_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return binning.representatives(lines(spark, sf), NUMERIC, "y")


CORE = {"months_on_book": "scaled", "current_balance": "scaled", "segment": "woe_levels"}


@query()
def search_cores(spark: SparkSession, sf: str) -> DataFrame:
    """The stepwise core, its strongest part and an expert's, with the trace of each."""
    found = search.cores(book(spark, sf).filter("performance_date < DATE'2000-01-01'"), "default_flag", CORE, search.Rules(strong=1), expert=["segment", "months_on_book"])
    return spark.createDataFrame([(c, i, a, v, round(x, 6)) for c, trace in found.items() for i, (a, v, x) in enumerate(trace)] or [("", 0, "", "", 0.0)], "core string, step int, action string, column_name string, value double")


@query()
def macro_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Macro terms beside a core: kept where the sign agrees with its prior and the term matters."""
    terms = [("ticket", "yoy", 3), ("orders", "yoy", 0)]
    train = scenarios.with_terms(book(spark, sf), panels.macro(spark, sf), terms).filter("performance_date < DATE'2000-01-01'")
    return search.macro_screen(train, "default_flag", {"months_on_book": "scaled"}, {"ticket@yoy@3": -1, "orders@yoy@0": None})


@query()
def severity_cores(spark: SparkSession, sf: str) -> DataFrame:
    """Cores of a severity model by robust tests, with the trace of each."""
    trials = severity_search.SeverityTrials(seen_lines(spark, sf).filter("performance_date < DATE'1997-01-01'"), "lgd_realised", ["price", "size", "retail", "quantity"])
    found = severity_search.cores_of(trials, ["price", "size", "retail", "quantity"], search.Rules(strong=1), expert=["price", "size"])
    trials.close()
    return spark.createDataFrame([(c, i, a, v, round(x, 6)) for c, trace in found.items() for i, (a, v, x) in enumerate(trace)], "core string, step int, action string, column_name string, value double")


@query()
def severity_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Severity models of a core and macro terms, fitted before 1997 and measured before and after."""
    terms = [("ticket", "yoy", 3), ("orders", "yoy", 0)]
    seen = scenarios.with_terms(seen_lines(spark, sf), panels.macro(spark, sf), terms)
    return severity_search.fits(seen, "lgd_realised", {"expert": ["price", "quantity"]}, ["ticket@yoy@3", "orders@yoy@0"], "1997-01-01", search.Rules(screen=0.25))


@query()
def spline_knots(spark: SparkSession, sf: str) -> DataFrame:
    """Knots of default by age, and of severity by price, found by search."""
    age = knots.search(book(spark, sf), "months_on_book", "default_flag").knots
    loss = knots.search(seen_lines(spark, sf), "price", "lgd_realised", 3, 40, severity=True).knots
    return spark.createDataFrame([("months_on_book", "default_flag", age), ("price", "lgd_realised", loss)], "column_name string, target string, knots array<double>")


BASIS_SQL = f"""{LINES_SQL}, b0 AS (SELECT y, price AS v, greatest(price - 20000, 0) AS h1, greatest(price - 45000, 0) AS h2 FROM lines),
b1 AS (SELECT y, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z1, h1 - avg(h1) OVER () AS h1, h2 - avg(h2) OVER () AS h2 FROM b0),
b2 AS (SELECT y, z1, h1 - z1 * avg(h1 * z1) OVER () AS r, h2 FROM b1), b3 AS (SELECT y, z1, r / stddev_pop(r) OVER () AS z2, h2 FROM b2),
b4 AS (SELECT y, z1, z2, h2 - z1 * avg(h2 * z1) OVER () - z2 * avg(h2 * z2) OVER () AS r FROM b3), b5 AS (SELECT y, z1, z2, r / stddev_pop(r) OVER () AS z3 FROM b4)"""


@query(f"WITH {BASIS_SQL} " + " UNION ALL ".join(f"SELECT 'price~{i}' AS basis, round(min(z{i}), 5) AS least, round(max(z{i}), 5) AS greatest, round(var_pop(z{i}), 6) AS variance, round(avg(z{i} * y), 6) AS with_target FROM b5" for i in (1, 2, 3)))
def spline_basis(spark: SparkSession, sf: str) -> DataFrame:
    """The uncorrelated form of a spline; a knot beyond the values earns no column."""
    rows = lines(spark, sf).select("price", "y").persist()
    term = estimate.spline_term(rows, "price", [20_000.0, 45_000.0, 1e9], 0.0)
    cells = [F.struct(F.lit(n).alias("basis"), c.alias("z")) for n, c in term.columns()]
    g = rows.select("y", F.explode(F.array(*cells)).alias("x")).groupBy("x.basis")
    z = F.col("x.z")
    return g.agg(F.round(F.min(z), 5).alias("least"), F.round(F.max(z), 5).alias("greatest"), F.round(F.var_pop(z), 6).alias("variance"), F.round(F.avg(z * F.col("y")), 6).alias("with_target"))


DIGESTED = {"account_id": "BIGINT", "current_balance": "DOUBLE", "interest_rate": "DOUBLE", "months_on_book": "INT"}


@query(f"""WITH {BOOK_SQL} SELECT substring(sha256(concat_ws('|', {", ".join(f"concat_ws(':', '{c}', " + ", ".join(f"printf('%.5e', {f}({c})::DOUBLE)" for f in ("avg", "stddev_samp", "min", "max")) + ")" for c in sorted(DIGESTED))})), 1, 12) AS digest FROM book""")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return quality.content_digest(book(spark, sf).select(*DIGESTED, "segment"))


FORM_KNOT, FORM_CENTER, FORM_SCALE, FORM_BETA = 40_000.0, 30_000.0, 20_000.0, [-0.1, 0.15, -0.2]


def _form_sql() -> str:
    eta = " + ".join(f"({b}::DOUBLE) * x{i}" for i, b in enumerate(FORM_BETA))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    h = ", ".join(f"sum(x{i} * x{j} * p * (1 - p)) AS h{i}{j}, sum(x{i} * x{j} * (y - p) * (y - p)) AS m{i}{j}" for i, j in pairs)
    # The last row of the inverse of a symmetric 3 x 3 matrix, by cofactors.
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    r = ["(h01 * h12 - h02 * h11)", "(h01 * h02 - h00 * h12)", "(h00 * h11 - h01 * h01)"]
    var = " + ".join(f"{r[i]} * {r[j]} * m{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3))
    return f"""WITH {SEEN_SQL}, x AS (SELECT lgd_realised AS y, 1.0::DOUBLE AS x0, (price - {FORM_CENTER}) / {FORM_SCALE} AS x1, greatest(price - {FORM_KNOT}, 0) / {FORM_SCALE} AS x2 FROM seen),
s AS (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM x), g AS (SELECT count(*) AS n, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, sum((y - p) * (y - p) / (p * (1 - p))) / (count(*) - 3) AS phi, {h} FROM s)
SELECT n, 3 AS parameters, round(ll, 5) AS log_likelihood, round(phi, 8) AS dispersion, round(-2 * ll / phi + 3 * ln(n), 4) AS bic, round({FORM_BETA[2]}::DOUBLE * {FORM_BETA[2]}::DOUBLE * {det} * {det} / ({var}), 4) AS wald FROM g"""


@query(_form_sql())
def severity_form_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Quasi-likelihood, dispersion, scaled BIC and the robust test of a bend, at fixed coefficients."""
    rows = forms.severity_cells(seen_lines(spark, sf), "price", "lgd_realised", FORM_CENTER, FORM_SCALE, [FORM_KNOT])
    s = forms.quasi_statistics(rows, FORM_BETA, [2])
    row = (s["n"], s["parameters"], round(s["log_likelihood"], 5), round(s["dispersion"], 8), round(forms.scaled_bic(s, s["dispersion"]), 4), round(s["wald"], 4))
    return spark.createDataFrame([row], "n long, parameters int, log_likelihood double, dispersion double, bic double, wald double")
