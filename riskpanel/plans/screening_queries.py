"""Queries of screening in depth: severity against macro terms, exact frames, optimal bins, null floors, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, evaluate, frames, macro, macro_library, macro_severity, null_floors, optimal_binning
from ..sources import panels
from ..sources.panels import BOOK_SQL, LINES_SQL, NUMERIC, book, lines, unpivot_sql
from .queries import COHORT_SQL, PAIRS, SCORED_SQL, TERMS_SQL, query, scored

LAGS = [0, 3, 6, 9, 12]


def area_sql(a: str, df: str, steps: int = 400) -> str:
    return f"list_sum(list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i IN (0, {steps}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END::DOUBLE * pow(sin({a} * (i / {steps}.0::DOUBLE) ** 2), {df} - 1) * 2 * {a} * (i / {steps}.0::DOUBLE)))"


CANDIDATES_SQL = f"{TERMS_SQL}, {LINES_SQL.strip()}, c AS (SELECT key || '@' || transform || '@' || lag AS candidate, CAST(month + to_months(lag) AS DATE) AS month, value AS x FROM terms, (SELECT unnest({LAGS}) AS lag) WHERE value IS NOT NULL)"
SEEN_SQL = "d AS (SELECT performance_date AS month, greatest(0, least(1, lgd_realised)) AS s FROM lines WHERE y = 1 AND lgd_realised IS NOT NULL)"


#: Ranks by candidate and the t of their correlation, of the candidates in view.
SEVERITY_SQL = """dc AS (SELECT month, s, count(*) AS n FROM d GROUP BY 1, 2),
j AS (SELECT candidate, month, round(x, 9) AS x, s, n FROM {view} JOIN dc USING (month)),
ys AS (SELECT candidate, s, sum(n) AS t FROM j GROUP BY 1, 2), yr AS (SELECT candidate, s, sum(t) OVER (PARTITION BY candidate ORDER BY s) - t + (t + 1) / 2 AS ry FROM ys),
xs AS (SELECT candidate, x, sum(n) AS t FROM j GROUP BY 1, 2), xr AS (SELECT candidate, x, sum(t) OVER (PARTITION BY candidate ORDER BY x) - t + (t + 1) / 2 AS rx FROM xs),
r AS (SELECT candidate, sum(n)::BIGINT AS n, count(DISTINCT month) AS months, sum(n * rx * ry) - sum(n * rx) * sum(n * ry) / sum(n) AS cov, sum(n * rx * rx) - sum(n * rx) ** 2 / sum(n) AS vx, sum(n * ry * ry) - sum(n * ry) ** 2 / sum(n) AS vy FROM j JOIN yr USING (candidate, s) JOIN xr USING (candidate, x) GROUP BY 1),
m AS (SELECT DISTINCT candidate, month, x FROM j), md AS (SELECT *, x - avg(x) OVER (PARTITION BY candidate) AS dx FROM m), ml AS (SELECT *, dx * lag(dx) OVER (PARTITION BY candidate ORDER BY month) AS l FROM md),
a AS (SELECT candidate, least(0.99, (sum(l) / sum(dx * dx)) ** 2) AS q, max(x) - min(x) AS span FROM ml GROUP BY 1),
e AS (SELECT r.*, n >= 30 AND span > 1e-12 AND vy > 1e-6 AS ok, least(months, CASE WHEN months < 12 THEN months ELSE greatest(4, months * (1 - q) / (1 + q)) END) AS ne, cov / sqrt(vx * vy) AS rho FROM r JOIN a USING (candidate)),
t AS (SELECT candidate, n, months, CASE WHEN ok THEN ne END AS ne, CASE WHEN ok THEN rho END AS r, CASE WHEN ok AND ne > 2 AND abs(rho) < 1 THEN rho * sqrt((ne - 2) / (1 - rho * rho)) END AS t FROM e)"""


@query(f"""WITH {CANDIDATES_SQL}, {SEEN_SQL},
{SEVERITY_SQL.format(view="c")}
SELECT candidate, n, months, round(ne, 4) AS n_effective, round(r, 7) AS r, round(t, 5) AS t, CASE WHEN t IS NOT NULL THEN round({area_sql("atan2(sqrt(ne - 2), abs(t))", "(ne - 2)")} / {area_sql("(pi() / 2)", "(ne - 2)")}, 6) END AS p FROM t""")
def macro_severity_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Every macro candidate's rank correlation with the severity of single defaults."""
    # Rounded, as equal changes of a term differ in their last digits from engine to engine.
    candidates = macro.lagged(macro.transformed(panels.macro(spark, sf)), LAGS).withColumn("value", F.round("value", 9))
    found = macro_severity.rank_correlations(candidates, macro_severity.severity_counts(lines(spark, sf), "y"))
    return found.select("candidate", "n", "months", *[F.round(c, d).alias(c) for c, d in (("n_effective", 4), ("r", 7), ("t", 5), ("p", 6))])


@query(f"""WITH {CANDIDATES_SQL}, {SEEN_SQL},
o AS (SELECT performance_date AS month, ln(((sum(y) + 0.5) / (count(*) + 1)) / (1 - (sum(y) + 0.5) / (count(*) + 1))) AS y FROM lines GROUP BY 1 HAVING count(*) >= 500),
q AS (SELECT date_trunc('quarter', month) AS quarter, avg(s) AS severity FROM d GROUP BY 1)
SELECT candidate, c.month, round(x, 5) AS value, round(y, 7) AS log_odds, round(severity, 8) AS severity FROM c LEFT JOIN o ON c.month = o.month LEFT JOIN q ON date_trunc('quarter', c.month) = quarter
WHERE c.month BETWEEN (SELECT min(month) FROM o) AND (SELECT max(month) FROM o)""")
def macro_beside_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every macro candidate beside the default log odds of its month and the mean severity of its quarter."""
    df = lines(spark, sf)
    candidates = macro.lagged(macro.transformed(panels.macro(spark, sf)), LAGS).filter("value IS NOT NULL")
    found = macro_severity.candidate_series(candidates.select("candidate", "month", "value"), macro.target_log_odds(df, "y"), macro_severity.severity_counts(df, "y"))
    return found.select("candidate", "month", *[F.round(c, d).alias(c) for c, d in (("value", 5), ("log_odds", 7), ("severity", 8))])


PRIORS = {"orders": -1, "sales_growth": -1, "ticket_yoy": 1}
P_SQL = f"{area_sql('atan2(sqrt(ne - 2), abs(t))', '(ne - 2)')} / {area_sql('(pi() / 2)', '(ne - 2)')}"


@query(f"""WITH {CANDIDATES_SQL}, {SEEN_SQL},
o AS (SELECT performance_date AS month, ln(((sum(y) + 0.5) / (count(*) + 1)) / (1 - (sum(y) + 0.5) / (count(*) + 1))) AS y FROM lines GROUP BY 1 HAVING count(*) >= 500),
v AS (SELECT candidate, month, round(x, 9) AS x FROM c WHERE month BETWEEN (SELECT min(month) FROM o) AND (SELECT max(month) FROM o) QUALIFY count(*) OVER (PARTITION BY candidate) >= 24),
{SEVERITY_SQL.format(view="v")},
pb AS (SELECT candidate, month, x - avg(x) OVER p AS dx, y - avg(y) OVER p AS dy FROM v JOIN o USING (month) WINDOW p AS (PARTITION BY candidate)),
pl AS (SELECT *, dx * lag(dx) OVER s AS px, dy * lag(dy) OVER s AS py FROM pb WINDOW s AS (PARTITION BY candidate ORDER BY month)),
pg AS (SELECT candidate, count(*) AS n, round(sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)), 7) AS r, greatest(-0.99, least(0.99, sum(px) / sum(dx * dx) * (sum(py) / sum(dy * dy)))) AS q FROM pl GROUP BY 1 HAVING count(*) >= 24 AND sum(dx * dx) > 1e-12 AND sum(dy * dy) > 1e-12),
pt AS (SELECT *, round(greatest(4, n * (1 - q) / (1 + q)), 4) AS ne FROM pg), pp AS (SELECT *, CASE WHEN ne > 2 AND abs(r) < 1 THEN r * sqrt((ne - 2) / (1 - r * r)) END AS t FROM pt),
ps AS (SELECT candidate, n, ne, r, CASE WHEN t IS NOT NULL THEN {P_SQL} END AS p FROM pp), ts AS (SELECT candidate, n, ne, r, CASE WHEN t IS NOT NULL THEN {P_SQL} END AS p FROM t),
k AS (SELECT candidate, split_part(candidate, '@', 1) AS key, split_part(candidate, '@', 2) AS transform, split_part(candidate, '@', 3)::INT AS lag, count(*) AS months, CASE split_part(candidate, '@', 1) WHEN 'orders' THEN -1 WHEN 'sales' THEN -1 WHEN 'ticket' THEN 1 END AS expected_sign FROM v GROUP BY 1),
z AS (SELECT k.*, ps.n AS dn, ps.ne AS dne, ps.r AS dr, ps.p AS dp, CASE WHEN ps.r > 0 THEN 1 WHEN ps.r IS NOT NULL THEN -1 END AS ds, ts.n AS sn, ts.ne AS sne, ts.r AS sr, ts.p AS sp, CASE WHEN ts.r > 0 THEN 1 WHEN ts.r IS NOT NULL THEN -1 END AS ss FROM k LEFT JOIN ps USING (candidate) LEFT JOIN ts USING (candidate))
SELECT candidate, key, transform, lag, months, expected_sign, dn AS default_n, dne AS default_n_effective, dr AS default_r, round(dp, 5) AS default_p, ds AS default_sign, ds = expected_sign AS default_sign_ok,
       sn AS severity_n, round(sne, 4) AS severity_n_effective, round(sr, 7) AS severity_r, round(sp, 5) AS severity_p, ss AS severity_sign, ss = expected_sign AS severity_sign_ok FROM z""")
def macro_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The library of macro candidates over the estimation window: both correlations and signs of every term at every lag."""
    df = lines(spark, sf)
    candidates = macro.lagged(macro.transformed(panels.macro(spark, sf)), LAGS).withColumn("value", F.round("value", 9))
    found = macro_library.library(candidates, macro.target_log_odds(df, "y"), macro_severity.severity_counts(df, "y"), PRIORS)
    digits = {"n_effective": 4, "r": 7, "p": 5}
    return found.withColumns({f"{side}_{c}": F.round(f"{side}_{c}", d) for side in ("default", "severity") for c, d in digits.items()})


@query()
def candidate_unit_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Test of a unit root of every macro candidate over the months of the panel."""
    candidates = macro.lagged(macro.transformed(panels.macro(spark, sf)), LAGS)
    return macro_library.unit_roots(macro_library.windowed(candidates, macro.target_log_odds(lines(spark, sf), "y", 1)))


FRAME_KEY = ["account_id", "performance_date"]
#: A third of the rows of book at any size is more than its events, and less than all.
FRAME_SQL = f"""{BOOK_SQL}, h AS (SELECT account_id, performance_date, default_flag, current_balance, ('0x' || substr(md5(account_id || '|' || strftime(performance_date, '%Y-%m-%d')), 1, 15))::BIGINT AS h FROM book),
z AS (SELECT count(*) // 3 AS n, sum(default_flag)::BIGINT AS e FROM book), o AS (SELECT *, row_number() OVER (PARTITION BY default_flag ORDER BY h) AS k FROM h),
frame AS (SELECT account_id, performance_date, default_flag, current_balance FROM o, z WHERE default_flag = 1 OR k <= greatest(n - e, 1000))"""


def third_of_book(spark: SparkSession, sf: str) -> frames.Frame:
    return frames.event_frame(book(spark, sf), "default_flag", lambda rows: rows // 3, FRAME_KEY)


@query(f"WITH {FRAME_SQL} SELECT * FROM frame")
def event_preserving_frame(spark: SparkSession, sf: str) -> DataFrame:
    """A frame of exactly a third of the book's rows, with all its events."""
    return third_of_book(spark, sf).rows.select("account_id", "performance_date", "default_flag", "current_balance")


PRE_BINS, MOST_BINS = 12, 5
INFORMATION = "((e + h) / te - (n - e + h) / tg) * ln(((e + h) / te) / ((n - e + h) / tg))"


def merges_sql(counts: str, groups: str, trend: bool, most: int, share: float) -> str:
    """All merges of neighbouring pre-bins (bit b - 1 of a mask: a bin begins at pre-bin b), in best: the one of most information."""
    grown = "bool_and(coalesce(up, true)) OR bool_and(coalesce(down, true))" if trend else "true"
    return f"""{counts}, tot AS (SELECT {groups}, sum(n) AS tn, sum(e) AS te, sum(n - e) AS tg, max(bin) AS last FROM pre GROUP BY ALL),
masks AS (SELECT *, unnest(range(0, (1 << last)::BIGINT)) AS mask FROM tot),
seg AS (SELECT {groups}, mask, tn, te, tg, bit_count(mask & ((1 << bin) - 1)) AS seg, min(bin) AS start, sum(n) AS n, sum(e) AS e FROM masks JOIN pre USING ({groups}) GROUP BY ALL),
rated AS (SELECT *, CASE WHEN e = 0 OR e = n THEN 0.5 ELSE 0 END AS h, e / n >= lag(e / n) OVER w AS up, e / n <= lag(e / n) OVER w AS down, bool_and(true) OVER w AS seen FROM seg WINDOW w AS (PARTITION BY {groups}, mask ORDER BY seg)),
merge AS (SELECT {groups}, mask, count(*)::INT AS bins, sum({INFORMATION}) AS iv, string_agg(start::VARCHAR, ',' ORDER BY start) AS starts,
          CASE WHEN bool_and(coalesce(up, true)) THEN 'ascending' ELSE 'descending' END AS trend FROM rated GROUP BY ALL HAVING bool_and(n >= greatest(30, {share} * tn)) AND count(*) <= {most} AND ({grown})),
best AS (SELECT {groups}, max((iv, -bins, mask))[1] AS iv, arg_max(bins, (iv, -bins)) AS bins, arg_max(starts, (iv, -bins)) AS starts, arg_max(trend, (iv, -bins)) AS trend FROM merge GROUP BY {groups})"""


PRE_SQL = f"""{LINES_SQL}, v AS (SELECT * FROM ({unpivot_sql("lines", NUMERIC, "y")}) WHERE value IS NOT NULL),
q AS (SELECT name, list_distinct(quantile_cont(value, [{", ".join(f"{i / PRE_BINS}" for i in range(1, PRE_BINS))}])) AS edges FROM v GROUP BY 1),
pre AS (SELECT name, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) AS n, sum(y)::BIGINT AS e FROM v JOIN q USING (name) GROUP BY 1, 2)"""


def pre_bins(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cells = binning.value_cells(panels.unpivoted(lines(spark, sf), NUMERIC, "y"), "y")
    edges = binning.quantile_edges(cells, PRE_BINS, "n")
    return binning.bin_counts(cells, edges, "e", "n"), edges


@query(f"WITH {merges_sql(PRE_SQL, 'name', True, MOST_BINS, 0.02)} SELECT name AS column_name, bins, round(iv, 9) AS iv, trend, starts FROM best")
def optimal_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Of each numeric column the monotone merge of its pre-bins that has most information; the SQL tries all merges."""
    found = optimal_binning.optimal_bins(*pre_bins(spark, sf), most=MOST_BINS)
    return found.select("column_name", "bins", F.round("iv", 9).alias("iv"), "trend", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query()
def permutation_null_floors(spark: SparkSession, sf: str) -> DataFrame:
    """Of each numeric column the information that a permuted target shows after optimal binning."""
    return null_floors.permutation_floor(pre_bins(spark, sf)[0], most=MOST_BINS, trend="auto")


SHAPES = [("numeric", 8), ("categorical", 10), ("categorical", 120)]
DRAWS = 6


def probe_sql(kind: str, levels: int) -> str:
    ends = [i / levels for i in range(1, levels)] if kind == "numeric" else null_floors.zipf_shares(levels)
    return f"""{BOOK_SQL}, u AS (SELECT default_flag AS y, draw, ('0x' || substr(md5(account_id || '|' || strftime(performance_date, '%Y-%m-%d') || '|{kind}{levels}|' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM book, (SELECT unnest(range(1, {DRAWS + 1})) AS draw)),
pre AS (SELECT draw, len(list_filter({[float(x) for x in ends]}, lambda s: s <= u)) AS bin, count(*) AS n, sum(y)::BIGINT AS e FROM u GROUP BY 1, 2)"""


def shape_sql(kind: str, levels: int) -> str:
    if kind == "numeric":
        ivs = f"{merges_sql(probe_sql(kind, levels), 'draw', False, 8, 0.02)}, ivs AS (SELECT draw, iv FROM best)"
    else:
        ivs = f"""{probe_sql(kind, levels)}, o AS (SELECT *, sum(n) OVER (PARTITION BY draw) AS a, row_number() OVER (PARTITION BY draw ORDER BY n DESC, bin) AS k FROM pre),
g AS (SELECT draw, CASE WHEN n >= 0.01 * a AND k <= 12 THEN bin ELSE -1 END AS bin, sum(n) AS n, sum(e) AS e FROM o GROUP BY 1, 2),
t AS (SELECT *, sum(e) OVER (PARTITION BY draw) AS te, sum(n - e) OVER (PARTITION BY draw) AS tg, CASE WHEN e = 0 OR e = n THEN 0.5 ELSE 0 END AS h FROM g), ivs AS (SELECT draw, sum({INFORMATION}) AS iv FROM t GROUP BY 1)"""
    return f"SELECT * FROM (WITH {ivs} SELECT '{kind}' AS kind, {levels} AS levels, round(avg(iv), 9) AS mean_iv, round(avg(iv) + 2 * stddev_pop(iv), 9) AS floor FROM ivs)"


@query(" UNION ALL ".join(shape_sql(*s) for s in SHAPES))
def shape_null_floors(spark: SparkSession, sf: str) -> DataFrame:
    """The information of columns without any, by shape: a continuous one, and narrow and wide level columns."""
    b, out = book(spark, sf).select("default_flag", *FRAME_KEY), None
    for kind, levels in SHAPES:
        own = null_floors.shape_floor(b, "default_flag", FRAME_KEY, kind, levels, DRAWS, 8 if kind == "numeric" else 12)
        out = own if out is None else out.unionByName(own)
    return out.select("kind", "levels", F.round("mean_iv", 9).alias("mean_iv"), F.round("floor", 9).alias("floor"))


@query(f"WITH {LINES_SQL}, " + ", ".join(f"j{i} AS (SELECT {a} AS x, {b} AS y FROM lines WHERE {a} IS NOT NULL AND {b} IS NOT NULL), r{i} AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM j{i})" for i, (a, b) in enumerate(PAIRS)) + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 7) AS r FROM r{i}" for i, (a, b) in enumerate(PAIRS)))
def rank_correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman's correlation of all pairs of numeric columns."""
    return binning.rank_correlations(lines(spark, sf), NUMERIC)


@query(f"WITH {LINES_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lines" for a, b in PAIRS) + ") SELECT a, b, r, abs(r) >= 0.9 AS high FROM c")
def correlation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The correlation report's pairs; its order of columns, which comes of a tree, has no SQL."""
    return binning.correlation_report(lines(spark, sf), NUMERIC).select("a", "b", "r", "high")


@query(f"""WITH {SCORED_SQL}, q AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM scored), b AS (SELECT len(list_filter(e, lambda x: x <= p)) + 1 AS bin, y, p FROM scored, q),
g AS (SELECT bin, count(*) AS n, sum(y) AS o, sum(p) AS x FROM b GROUP BY 1), h AS (SELECT count(*)::INT AS groups, sum(round(CASE WHEN x > 0 AND x < n THEN pow(o - x, 2) / (x * (1 - x / n)) ELSE 0 END, 6)) AS s FROM g)
SELECT groups, round(s, 4) AS statistic, groups - 2 AS df, round(exp(-s / 2) * list_sum(list_transform(range(0, (groups - 2) // 2), lambda i: pow(s / 2, i) / gamma(i + 1))), 6) AS p_value FROM h""")
def hosmer_lemeshow_test(spark: SparkSession, sf: str) -> DataFrame:
    """The calibration test; of an even number of degrees of freedom its tail is a finite sum."""
    found = evaluate.hosmer_lemeshow_table(evaluate.calibration(scored(spark, sf)))
    return found.select("groups", F.round("statistic", 4).alias("statistic"), "df", F.round("p_value", 6).alias("p_value"))


#: The beta distribution's mass below a rate, by the trapezoid rule over its peak; a rate lies within Jeffreys' interval if that is within 2.5 and 97.5 percent.
@query(f"""WITH {COHORT_SQL}, k AS (SELECT period, predicted, events, n, events + 0.5 AS a, n - events + 0.5 AS b FROM coh),
w AS (SELECT *, greatest(0, a / (a + b) - 12 * sqrt(a * b / (a + b + 1)) / (a + b)) AS lo, least(1, a / (a + b) + 16 * sqrt(a * b / (a + b + 1)) / (a + b)) AS hi FROM k),
g AS (SELECT period, predicted, events, n, lo, hi, lo + (hi - lo) * (i + 0.5) / 40000 AS t, (a - 1) * (ln(lo + (hi - lo) * (i + 0.5) / 40000) - ln(a / (a + b))) + (b - 1) * (ln(1 - lo - (hi - lo) * (i + 0.5) / 40000) - ln(b / (a + b))) AS l FROM w, range(0, 40000) r(i)),
m AS (SELECT period, any_value(events) AS events, any_value(n) AS n, sum(exp(l)) FILTER (WHERE t <= predicted) / sum(exp(l)) AS mass FROM g GROUP BY 1),
c AS (SELECT period, CASE WHEN events = 0 THEN coalesce(mass, 0) <= 0.975 WHEN events = n THEN coalesce(mass, 0) >= 0.025 ELSE coalesce(mass, 0) BETWEEN 0.025 AND 0.975 END AS covered FROM m),
s AS (SELECT covered, unnest(['all', CASE WHEN period < DATE '2000-01-01' THEN 'in_time' ELSE 'out_of_time' END]) AS slice FROM c)
SELECT slice, count(*) AS periods, count(*) FILTER (WHERE covered) AS covered, round(avg(covered::INT), 6) AS coverage FROM s GROUP BY 1""")
def interval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How often predicted rates lie within the cohorts' intervals."""
    return evaluate.coverage(evaluate.with_intervals(evaluate.cohorts(scored(spark, sf))), "2000-01-01")
