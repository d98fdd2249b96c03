"""The queries of the panel operators over the test tables, and their SQL for DuckDB where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import binning, curves, estimate, evaluate, losses, macro, quality, ranks
from ..sources import panels, tape
from ..sources.panels import BOOK_SQL, CATEGORICAL, LINES_SQL, MACRO_SQL, NUMERIC, book, lines, table, unpivot_sql
from ..streaming import panel_stream
from . import search, specs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


ANNUAL = "(1 - pow(1 - greatest(0, least(1, {m})), 12)) * 100"
RATES = f"count(*) AS n, sum(default_flag)::BIGINT AS defaults, round(sum(current_balance), 2) AS exposure, round(avg(default_flag), 8) AS rate, round({ANNUAL.format(m='avg(default_flag)')}, 6) AS annual_pct"


@query(f"WITH {BOOK_SQL} SELECT performance_date AS period, {RATES} FROM book GROUP BY 1")
def default_rates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.default_rates(book(spark, sf))


@query(f"WITH {BOOK_SQL} SELECT CAST(date_trunc('quarter', performance_date) AS DATE) AS period, segment, {RATES} FROM book GROUP BY 1, 2")
def default_rates_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return quality.default_rates(book(spark, sf), ["segment"], "QS")


@query(f"WITH {BOOK_SQL} SELECT * FROM book")
def book_panel(spark: SparkSession, sf: str) -> DataFrame:
    return book(spark, sf)


@query(f"""WITH {BOOK_SQL}, s AS (SELECT count(*) AS n_rows, count(DISTINCT account_id) AS accounts, sum(default_flag)::BIGINT AS defaults, min(performance_date) AS first_month, max(performance_date) AS last_month, round(sum(current_balance), 0) AS balance, avg(default_flag) AS m FROM book)
SELECT n_rows, accounts, defaults, first_month, last_month, round({ANNUAL.format(m="m")}, 6) AS annual_pct,
       sha256(concat_ws('|', n_rows, accounts, defaults, strftime(first_month, '%Y-%m-%d'), strftime(last_month, '%Y-%m-%d'), balance::DECIMAL(38, 0)))[1 : 12] AS fingerprint FROM s""")
def book_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summary(book(spark, sf))


def broken_book(spark: SparkSession, sf: str) -> DataFrame:
    """book with planted faults: repeated rows, missing months, negative balances, rows after default."""
    b = book(spark, sf).select("account_id", "performance_date", "default_flag", "current_balance", "origination_date")
    kept = b.filter(~((F.col("account_id") % 50 == 7) & (exprs.month_index(F.col("performance_date")) - exprs.month_index(F.col("origination_date")) == 3)))
    twice = b.filter("account_id % 40 = 3 AND performance_date = origination_date")
    late = b.filter("default_flag = 1 AND account_id % 3 = 0").withColumns({"performance_date": F.add_months("performance_date", 1), "default_flag": F.lit(0)})
    out = kept.unionByName(twice).unionByName(late)
    return out.withColumn("current_balance", F.when(F.col("account_id") % 60 == 11, -F.col("current_balance")).otherwise(F.col("current_balance")))


BROKEN_SQL = f"""{BOOK_SQL},
b0 AS (SELECT account_id, performance_date, default_flag, current_balance, origination_date, months_on_book AS mob FROM book),
broken AS (SELECT account_id, performance_date, default_flag, CASE WHEN account_id % 60 = 11 THEN -current_balance ELSE current_balance END AS current_balance, origination_date FROM (
  SELECT * FROM b0 WHERE NOT (account_id % 50 = 7 AND mob = 3) UNION ALL SELECT * FROM b0 WHERE account_id % 40 = 3 AND performance_date = origination_date
  UNION ALL SELECT account_id, CAST(performance_date + INTERVAL 1 MONTH AS DATE), 0, current_balance, origination_date, mob FROM b0 WHERE default_flag = 1 AND account_id % 3 = 0))"""
CHECKS_SQL = f"""
w AS (SELECT *, lag(performance_date) OVER (PARTITION BY account_id ORDER BY performance_date) AS prev, min(performance_date) FILTER (WHERE default_flag = 1) OVER (PARTITION BY account_id) AS fd FROM {{view}}),
c AS (SELECT count(*) FILTER (WHERE prev = performance_date) AS dup, count(*) FILTER (WHERE 12 * (year(performance_date) - year(prev)) + month(performance_date) - month(prev) <> 1) AS gaps,
             count(*) FILTER (WHERE current_balance < 0) AS neg, count(*) FILTER (WHERE performance_date > fd) AS after, count(*) FILTER (WHERE performance_date < origination_date) AS early,
             {ANNUAL.format(m="avg(default_flag)")} AS rate, max(performance_date) - min(performance_date) AS days FROM w),
m AS (SELECT count(*) AS multi FROM (SELECT account_id FROM {{view}} GROUP BY 1 HAVING sum(default_flag) > 1)),
k AS (SELECT 'unique account-month key' AS check_name, dup = 0 AS passed, 'critical' AS severity, dup AS n_affected FROM c
  UNION ALL SELECT 'no gaps in the monthly sequence', gaps = 0, 'serious', gaps FROM c UNION ALL SELECT 'balances are not negative', neg = 0, 'serious', neg FROM c
  UNION ALL SELECT 'history stops at default', after = 0, 'serious', after FROM c UNION ALL SELECT 'target fires once at most', multi = 0, 'critical', multi FROM m
  UNION ALL SELECT 'default rate is plausible', rate BETWEEN 0.1 AND 25, 'warning', 0 FROM c UNION ALL SELECT 'window is long enough', days / 365.25 >= 3, 'warning', 0 FROM c
  UNION ALL SELECT 'no performance before origination', early = 0, 'critical', early FROM c),
checks AS (SELECT check_name, passed, CASE WHEN passed THEN 'good' ELSE severity END AS severity, n_affected::BIGINT AS n_affected FROM k)"""


@query(f"WITH {BOOK_SQL}, {CHECKS_SQL.format(view='book')} SELECT * FROM checks")
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity(book(spark, sf))


@query(f"WITH {BROKEN_SQL}, {CHECKS_SQL.format(view='broken')} SELECT * FROM checks")
def integrity_of_broken_book(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity(broken_book(spark, sf))


@query(f"""WITH {BROKEN_SQL}, {CHECKS_SQL.format(view="broken")}
SELECT round(greatest(0, 100 * (1 - sum(CASE severity WHEN 'critical' THEN 5 WHEN 'serious' THEN 3 WHEN 'warning' THEN 1 ELSE 0 END) / (5 * count(*)))), 1)::DOUBLE AS score, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed FROM checks""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return quality.health_score(quality.integrity(broken_book(spark, sf)))


STATIC = ["segment", "nation", "c_acctbal", "vintage", "current_balance", "months_on_book"]


@query(f"WITH {BOOK_SQL}" + " UNION ALL ".join(f" SELECT '{c}' AS column_name, max(v) <= 1 AS static FROM (SELECT count(DISTINCT coalesce(CAST({c} AS VARCHAR), '?')) AS v FROM book GROUP BY account_id)" for c in STATIC))
def static_columns(spark: SparkSession, sf: str) -> DataFrame:
    return quality.static_columns(book(spark, sf), STATIC)


LONG_SQL = f"{LINES_SQL}, l AS ({unpivot_sql('lines', NUMERIC, 'y, performance_date, lgd_realised')}), v AS (SELECT * FROM l WHERE value IS NOT NULL)"


@query(f"""WITH {LONG_SQL}, q AS (SELECT name, quantile_cont(value, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM v GROUP BY 1)
SELECT name AS column_name, round(100 * (1 - count(value) / count(*)), 6) AS missing_pct, count(DISTINCT value) AS n_unique, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS sd,
       round(any_value(q)[1], 6) AS p1, round(any_value(q)[2], 6) AS p25, round(any_value(q)[3], 6) AS p50, round(any_value(q)[4], 6) AS p75, round(any_value(q)[5], 6) AS p99, min(value) AS least, max(value) AS most,
       count(*) FILTER (WHERE value < q[2] - 3 * (q[4] - q[2]) OR value > q[4] + 3 * (q[4] - q[2])) AS outliers
FROM l JOIN q USING (name) GROUP BY name""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.profile(lines(spark, sf), NUMERIC)


@query(f"""WITH {LONG_SQL}, s AS (SELECT name, avg(value) AS m, stddev_samp(value) AS sd, median(value) AS md FROM v GROUP BY 1), mo AS (SELECT name, max(c) AS c FROM (SELECT name, value, count(*) AS c FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT name AS column_name, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS sd, round(avg(pow((value - m) / s.sd, 3)), 5) AS skew, round(avg(pow((value - m) / s.sd, 4)) - 3, 5) AS kurtosis,
       round(median(abs(value - md)), 6) AS mad, round(any_value(mo.c) / count(*), 6) AS mode_share, round(100 * avg((value = 0)::INT), 6) AS zero_pct, round(100 * avg((value < 0)::INT), 6) AS negative_pct,
       bool_and(value = floor(value)) AS integral, round(CASE WHEN any_value(md) <> 0 THEN quantile_cont(value, 0.99) / any_value(md) END, 6) AS tail_ratio
FROM v JOIN s USING (name) JOIN mo USING (name) GROUP BY name""")
def univariate_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return quality.describe_numeric(lines(spark, sf), NUMERIC)


@query(f"""WITH {LINES_SQL}, l AS ({unpivot_sql("lines", CATEGORICAL, "y")}), c AS (SELECT name, value, count(*) / sum(count(*)) OVER (PARTITION BY name) AS s FROM l GROUP BY 1, 2)
SELECT name AS column_name, count(value) AS levels, round(sum(s * s), 8) AS hhi, round(100 * max(s), 6) AS top_pct, count(*) FILTER (WHERE s < 0.01) AS thin_levels FROM c GROUP BY 1""")
def univariate_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return quality.describe_categorical(lines(spark, sf), CATEGORICAL)


@query(f"WITH {LINES_SQL} SELECT coalesce(type, '(missing)') AS level, count(*) AS n FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_levels(spark: SparkSession, sf: str) -> DataFrame:
    return quality.top_levels(lines(spark, sf), "type")


@query(f"""WITH {LINES_SQL}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM lines), b AS (SELECT least(47, floor((price - lo) / ((hi - lo) / 48)))::INT AS bin, lo, hi, y FROM lines, e)
SELECT bin, round(lo + bin * ((hi - lo) / 48), 6) AS lo, count(*) AS n, sum(y)::BIGINT AS events, round(CASE WHEN count(*) >= 50 THEN sum(y) / count(*) END, 8) AS rate FROM b GROUP BY b.bin, lo, hi""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.histogram(lines(spark, sf), "price", "y")


@query(f"""WITH {LINES_SQL}, g AS (SELECT brand, count(*) AS n, sum(exposure) AS e, row_number() OVER (ORDER BY count(*) DESC, brand) AS r FROM lines GROUP BY 1)
SELECT CASE WHEN r <= 8 THEN brand ELSE '(other)' END AS band, sum(n)::BIGINT AS n, round(sum(e), 2) AS exposure, round(100 * sum(e) / sum(sum(e)) OVER (), 6) AS share_pct FROM g GROUP BY 1""")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    return quality.concentration(lines(spark, sf), "brand", "exposure")


@query(f"""WITH {LINES_SQL} SELECT ((size > 10)::INT + (size > 25)::INT + (size > 40)::INT)::INT AS band, count(*) AS n, round(sum(exposure), 2) AS exposure, round(100 * sum(exposure) / sum(sum(exposure)) OVER (), 6) AS share_pct FROM lines GROUP BY 1""")
def band_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return quality.band_concentration(lines(spark, sf), "size", "exposure", [10, 25, 40])


def with_sentinel(df: DataFrame) -> DataFrame:
    return df.withColumn("size", F.when((F.col("size") == 7) | (F.col("size") == 8), 999.0).otherwise(F.col("size")))


@query(f"""WITH {LINES_SQL}, s AS (SELECT * REPLACE (CASE WHEN size IN (7, 8) THEN 999 ELSE size END AS size) FROM lines), l AS ({unpivot_sql("s", ["size", "quantity"], "y")}),
c AS (SELECT name, value AS suspect, count(*) AS c, sum(count(*)) OVER (PARTITION BY name) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2 QUALIFY c >= 0.01 * n),
r AS (SELECT c.name, suspect, any_value(c) AS c, any_value(n) AS n, quantile_cont(value, [0.25, 0.75]) AS q FROM c JOIN l ON c.name = l.name AND value <> suspect GROUP BY 1, 2)
SELECT name AS column_name, suspect::DOUBLE AS value, round(c / n, 8) AS share FROM r WHERE suspect < q[1] - 1.5 * (q[2] - q[1]) OR suspect > q[2] + 1.5 * (q[2] - q[1])""")
def sentinel_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.sentinels(with_sentinel(lines(spark, sf)), ["size", "quantity"])


def woe_sql(counts: str, shrink: str = "0") -> str:
    return f"""{counts}, t AS (SELECT *, sum(events) OVER p AS te, sum(n - events) OVER p AS tg, sum(n) OVER p AS tn, CASE WHEN events = 0 OR n = events THEN 0.5 ELSE 0 END AS h, {shrink} AS k FROM counts WINDOW p AS (PARTITION BY name)),
u AS (SELECT *, (events + h) / greatest(te, 1) AS pe, (n - events + h) / greatest(tg, 1) AS pg FROM t),
w AS (SELECT name, bin, n, events, events / nullif(n, 0) AS rate, n / tn AS share, ln(pe / pg) * CASE WHEN k > 0 THEN events / (events + k) ELSE 1 END AS woe, (pe - pg) * ln(pe / pg) * CASE WHEN k > 0 THEN events / (events + k) ELSE 1 END AS iv,
             CASE WHEN n > 0 THEN (events / te) / (n / tn) END AS lift FROM u)"""


NUMERIC_WOE = woe_sql(f"""{LONG_SQL}, q AS (SELECT name, list_distinct(quantile_cont(value, [{", ".join(f"{i / 8}" for i in range(1, 8))}])) AS e FROM v GROUP BY 1),
z AS (SELECT l.name, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e, lambda x: x <= value)) END::INT AS bin, y FROM l JOIN q USING (name)),
every AS (SELECT name, unnest(generate_series(0, len(e)))::INT AS bin FROM q), cz AS (SELECT name, bin, count(*) AS n, sum(y)::BIGINT AS events FROM z GROUP BY 1, 2),
counts AS (SELECT name, bin, coalesce(n, 0) AS n, coalesce(events, 0) AS events FROM cz FULL JOIN every USING (name, bin))""")
LEVEL_WOE = woe_sql(f"""{LINES_SQL}, l AS ({unpivot_sql("lines", CATEGORICAL, "y")}), g AS (SELECT name, value, count(*) AS n, sum(y)::BIGINT AS events FROM l GROUP BY 1, 2),
r AS (SELECT *, sum(n) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY name) AS a, row_number() OVER (PARTITION BY name ORDER BY value IS NULL, n DESC, value) AS i FROM g),
rl AS (SELECT name, count(value) AS lv FROM g GROUP BY 1),
c1 AS (SELECT name, CASE WHEN value IS NULL THEN 'Missing' WHEN n >= 0.01 * a AND i <= 12 THEN value ELSE 'Other' END AS bin, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events FROM r GROUP BY 1, 2),
counts AS (SELECT c1.*, lv, sum(events) OVER (PARTITION BY name) AS ev FROM c1 JOIN rl USING (name))""", "CASE WHEN lv < 15 THEN 0 ELSE greatest(ev / lv, 5) END")
WOE_OUT = "SELECT name, bin, n, events, round(rate, 8) AS rate, round(share, 8) AS share, round(woe, 7) AS woe, round(iv, 8) AS iv, round(lift, 6) AS lift FROM w"
SCREEN_OUT = """SELECT name AS column_name, round(sum(iv), 8) AS iv, CASE WHEN round(sum(iv), 8) < 0.02 THEN 'not predictive' WHEN round(sum(iv), 8) < 0.1 THEN 'weak' WHEN round(sum(iv), 8) < 0.3 THEN 'medium' WHEN round(sum(iv), 8) < 0.5 THEN 'strong' ELSE 'suspicious' END AS band,
       round(max(lift), 6) AS max_lift, CASE WHEN max(lift) >= 25 AND sum(iv) >= 0.75 THEN 'likely' WHEN sum(iv) >= 0.5 THEN 'review' ELSE 'none' END AS leakage, count(*) AS bins, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events FROM w GROUP BY 1"""


def shown(woe: DataFrame) -> DataFrame:
    return woe.select("name", "bin", "n", "events", *[F.round(c, d).alias(c) for c, d in (("rate", 8), ("share", 8), ("woe", 7), ("iv", 8), ("lift", 6))])


@query(f"WITH {NUMERIC_WOE} {WOE_OUT}")
def bin_table_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return shown(binning.numeric_screen(lines(spark, sf), NUMERIC, "y"))


@query(f"WITH {LEVEL_WOE} {WOE_OUT}")
def bin_table_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return shown(binning.categorical_screen(lines(spark, sf), CATEGORICAL, "y"))


@query(f"WITH {NUMERIC_WOE} {SCREEN_OUT}")
def screen_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return binning.screen(binning.numeric_screen(lines(spark, sf), NUMERIC, "y"))


@query(f"WITH {LEVEL_WOE} {SCREEN_OUT}")
def screen_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return binning.screen(binning.categorical_screen(lines(spark, sf), CATEGORICAL, "y"))


@query(f"""WITH {NUMERIC_WOE} SELECT name AS column_name, CASE WHEN count(*) >= 3 THEN CASE WHEN arg_max(rate, bin) > arg_min(rate, bin) THEN 1 ELSE -1 END END AS sign FROM w WHERE bin >= 0 AND n > 0 GROUP BY 1""")
def observed_signs(spark: SparkSession, sf: str) -> DataFrame:
    return binning.observed_sign(binning.numeric_screen(lines(spark, sf), NUMERIC, "y"))


@query(f"""WITH {NUMERIC_WOE}, s AS (SELECT name, rate - lag(rate) OVER (PARTITION BY name ORDER BY bin) AS d FROM w WHERE bin >= 0 AND n > 0)
SELECT name AS column_name, CASE WHEN bool_and(d >= 0) THEN 'increasing' WHEN bool_and(d <= 0) THEN 'decreasing' ELSE 'none' END AS trend FROM s GROUP BY 1""")
def bin_trends(spark: SparkSession, sf: str) -> DataFrame:
    return binning.monotonicity(binning.numeric_screen(lines(spark, sf), NUMERIC, "y"))


@query()
def information_null_floor(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf)
    long = panels.unpivoted(df, NUMERIC, "y")
    cells = binning.value_cells(long, "y")
    return binning.null_floor(binning.bin_counts(cells, binning.quantile_edges(cells, 8, "n"), "e", "n"))


@query()
def monotone_bins(spark: SparkSession, sf: str) -> DataFrame:
    df = book(spark, sf)
    edges = binning.optimal_edges(df, "months_on_book", "default_flag")
    return df.groupBy(exprs.bin_index(F.col("months_on_book"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("default_flag").alias("events"))


PSI_SQL = """
e AS (SELECT name, list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS d FROM r WHERE base GROUP BY 1),
g AS (SELECT name, list_sort(d)[2 : greatest(len(d) - 1, 1)] AS e, len(d) AS m FROM e),
z AS (SELECT r.*, len(list_filter(e, lambda x: x <= value)) AS bin, m FROM r JOIN g USING (name)),
bc AS (SELECT name, bin, count(*) AS b FROM z WHERE base GROUP BY 1, 2), bt AS (SELECT name, sum(b) AS bn FROM bc GROUP BY 1),
ev AS (SELECT name, unnest(generate_series(0, len(e))) AS bin FROM g), c AS (SELECT name, period, bin, count(*) AS c FROM z GROUP BY 1, 2, 3), p AS (SELECT name, period, any_value(m) AS m, count(*) AS n FROM z GROUP BY 1, 2),
f AS (SELECT name, period, m, n, bn, CASE WHEN coalesce(c, 0) = 0 THEN 0.5 / n ELSE c / n END AS a, CASE WHEN coalesce(b, 0) = 0 THEN 0.5 / bn ELSE b / bn END AS x
      FROM p JOIN ev USING (name) JOIN bt USING (name) LEFT JOIN bc USING (name, bin) LEFT JOIN c USING (name, period, bin))
SELECT name AS column_name, period, n, CASE WHEN n < 50 OR any_value(bn) < 50 THEN NULL WHEN any_value(m) < 3 THEN 0 ELSE round(sum((a - x) * ln(a / x)), 8) END AS psi FROM f GROUP BY name, period, n HAVING n >= {least}"""


@query(f"""WITH {LONG_SQL}, r AS (SELECT name, value, CAST(date_trunc('quarter', performance_date) AS DATE) AS period, performance_date < (SELECT min(performance_date) + INTERVAL 12 MONTH FROM lines) AS base FROM v), {PSI_SQL.format(least=50)}""")
def psi_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return binning.psi_over_time(lines(spark, sf), NUMERIC)


@query(f"""WITH {LONG_SQL}, r AS (SELECT name, value, CAST(date_trunc('year', performance_date) AS DATE) AS period, performance_date < (SELECT min(performance_date) + INTERVAL 12 MONTH FROM lines) AS base FROM v WHERE name IN ('quantity', 'discount')), {PSI_SQL.format(least=500)}""")
def characteristic_stability(spark: SparkSession, sf: str) -> DataFrame:
    return binning.psi_over_time(lines(spark, sf), ["quantity", "discount"], freq="YS", least=500)


@query(f"""WITH {LINES_SQL} SELECT CAST(date_trunc('quarter', performance_date) AS DATE) AS period, CASE WHEN quantity IS NULL THEN -1 ELSE (quantity >= 10)::INT + (quantity >= 25)::INT + (quantity >= 40)::INT END::INT AS bin, count(*) AS n, sum(y)::BIGINT AS events,
       round(sum(y) / count(*), 8) AS rate FROM lines GROUP BY 1, 2 HAVING count(*) >= 250""")
def bivariate(spark: SparkSession, sf: str) -> DataFrame:
    return binning.bivariate(lines(spark, sf), "quantity", "y", [10, 25, 40])


PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lines" for a, b in PAIRS))
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return binning.correlations(lines(spark, sf), NUMERIC)


@query(f"""WITH {LINES_SQL}, b AS (SELECT quantity AS x, price AS z FROM lines), r AS (SELECT x, z, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS rz FROM b)
SELECT count(*) AS n, round(corr(rx, rz), 7) AS rho FROM r""")
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.spearman(lines(spark, sf), "quantity", "price").withColumn("rho", F.round("rho", 7))


@query()
def variance_inflation(spark: SparkSession, sf: str) -> DataFrame:
    return binning.vif(lines(spark, sf), NUMERIC)


@query()
def column_clusters(spark: SparkSession, sf: str) -> DataFrame:
    label = binning.clusters(binning.gram(lines(spark, sf), NUMERIC))
    return spark.createDataFrame(list(zip(NUMERIC, label, strict=True)), "column_name string, cluster int")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """book with a score that depends on account and age."""
    p = (20 + 4 * (F.col("account_id") % 25) + F.col("months_on_book") % 10) / F.lit(10000.0)
    return book(spark, sf).select("account_id", "performance_date", "segment", F.col("default_flag").alias("y"), p.alias("p"))


SCORED_SQL = f"{BOOK_SQL}, scored AS (SELECT account_id, performance_date, segment, default_flag AS y, (20 + 4 * (account_id % 25) + months_on_book % 10) / 10000.0::DOUBLE AS p FROM book)"


def auc_sql(by: str = "") -> str:
    keys, comma, part = by, f"{by}, " if by else "", f"PARTITION BY {by} " if by else ""
    return f"""s0 AS (SELECT {comma}p, count(*) AS n, sum(y) AS e FROM scored WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY {comma}p),
s1 AS (SELECT *, sum(n) OVER ({part}ORDER BY p) AS cn, sum(e) OVER ({part}ORDER BY p) AS ce, sum(n) OVER ({part}) AS tn, sum(e) OVER ({part}) AS te FROM s0),
s2 AS (SELECT *, round(abs(ce / te - (cn - ce) / (tn - te)), 12) AS gap FROM s1),
auc AS (SELECT {comma}any_value(tn)::BIGINT AS n, any_value(te)::BIGINT AS events, (sum(e * (cn - n + (n + 1) / 2)) - any_value(te) * (any_value(te) + 1) / 2) / nullif(any_value(te) * (any_value(tn) - any_value(te)), 0) AS a, max(gap) AS k,
               arg_max(p, struct_pack(gap := gap, q := -p)) AS ks_at FROM s2 {f"GROUP BY {keys}" if keys else ""})"""


AUC_OUT = "n, events, round(a, 8) AS auc, round(2 * a - 1, 8) AS gini, round(k, 8) AS ks, round(ks_at, 8) AS ks_score FROM auc"


@query(f"WITH {SCORED_SQL}, {auc_sql()} SELECT {AUC_OUT}")
def discrimination(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.discrimination(scored(spark, sf))


@query(f"WITH {SCORED_SQL}, {auc_sql('segment')} SELECT segment, {AUC_OUT}")
def discrimination_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.discrimination(scored(spark, sf), ["segment"])


@query(f"""WITH {SCORED_SQL} SELECT count(*) AS n, round(avg(pow(p - y, 2)), 8) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss, round({ANNUAL.format(m="avg(y)")}, 6) AS actual_annual, round({ANNUAL.format(m="avg(p)")}, 6) AS predicted_annual FROM scored""")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy(scored(spark, sf))


@query(f"""WITH {SCORED_SQL}, {auc_sql()}, a AS (SELECT ceil((tn - cn + n) * 120 / tn)::INT AS point, (te - ce + e) / te AS tpr, ((tn - cn + n) - (te - ce + e)) / (tn - te) AS fpr FROM s1)
SELECT point, round(max(tpr), 8) AS tpr, round(max(fpr), 8) AS fpr FROM a GROUP BY 1""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.curve_points(scored(spark, sf))


@query(f"""WITH {SCORED_SQL}, {auc_sql()}, g AS (SELECT p, e, n, te, tn, tn - cn AS above, unnest(generate_series(1, 10)) AS d FROM s1),
o AS (SELECT *, greatest(0, least(above + n, floor(tn * d / 10)) - greatest(above, floor(tn * (d - 1) / 10))) AS own FROM g),
t AS (SELECT d, sum(own) AS n, sum(e * own / n) AS events, sum(p * own) / sum(own) AS mp, any_value(te) AS te, any_value(tn) AS tn FROM o WHERE own > 0 GROUP BY 1)
SELECT d::INT AS decile, n::BIGINT AS n, round(events, 6) AS events, round(events / n, 8) AS event_rate, round(mp, 8) AS mean_predicted, round(100 * events / te, 6) AS capture_pct, round(100 * sum(events) OVER (ORDER BY d) / te, 6) AS cumulative_pct, round(events / n / (te / tn), 6) AS lift FROM t""")
def gains(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gains(scored(spark, sf))


@query(f"""WITH {SCORED_SQL}, q AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM scored), b AS (SELECT len(list_filter(e, lambda x: x <= p)) + 1 AS bin, y, p FROM scored, q),
g AS (SELECT bin, count(*) AS n, sum(y) AS o, sum(p) AS x FROM b GROUP BY 1)
SELECT bin::INT AS bin, n, o::BIGINT AS events, round(x / n, 8) AS predicted, round(o / n, 8) AS observed, round(CASE WHEN x > 0 AND x < n THEN pow(o - x, 2) / (x * (1 - x / n)) ELSE 0 END, 6) AS hl_part FROM g""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibration(scored(spark, sf))


COHORT_SQL = f"""{SCORED_SQL.replace("scored AS", "scored0 AS")}, scored AS (SELECT *, CAST(date_trunc('quarter', performance_date) AS DATE) AS period FROM scored0), {auc_sql("period")},
rates AS (SELECT period, count(*) AS rn, avg(y) AS ay, avg(p) AS ap FROM scored GROUP BY 1 HAVING count(*) >= 400),
coh AS (SELECT period, rn AS n, events, round(ay, 8) AS actual, round(ap, 8) AS predicted, round(a, 8) AS auc, round(2 * a - 1, 8) AS gini, round(k, 8) AS ks FROM rates JOIN auc USING (period))"""


@query(f"WITH {COHORT_SQL} SELECT * FROM coh")
def cohort_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.cohorts(scored(spark, sf))


@query()
def cohort_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.with_intervals(evaluate.cohorts(scored(spark, sf)))


@query(f"""WITH {COHORT_SQL}, er AS (SELECT period, actual, predicted, {ANNUAL.format(m="predicted")} - {ANNUAL.format(m="actual")} AS e FROM coh),
sl AS (SELECT *, unnest(['all', CASE WHEN period < DATE '2000-01-01' THEN 'in_time' ELSE 'out_of_time' END]) AS slice FROM er)
SELECT slice, count(*) AS periods, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(sum(predicted) / sum(actual), 6) AS ratio, arg_max(period, struct_pack(a := round(abs(e), 9), b := period)) AS worst FROM sl GROUP BY 1""")
def backtest_errors(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_summary(evaluate.cohorts(scored(spark, sf)), "2000-01-01")


@query(f"""WITH {SCORED_SQL}, {auc_sql("segment")}, whole AS (SELECT (sum(e * r) - any_value(te) * (any_value(te) + 1) / 2) / (any_value(te) * (any_value(tn) - any_value(te))) AS w FROM (
  SELECT e, sum(n) OVER (ORDER BY p) - n + (n + 1) / 2 AS r, sum(e) OVER () AS te, sum(n) OVER () AS tn FROM (SELECT p, count(*) AS n, sum(y) AS e FROM scored GROUP BY 1))),
g AS (SELECT segment, count(*) AS n, avg(y) AS ay, avg(p) AS ap FROM scored GROUP BY 1 HAVING count(*) >= 2000)
SELECT segment, g.n, round(a, 8) AS auc, round(round(a, 8) - round(w, 8), 8) AS delta, round(100 * (ap / ay - 1), 6) AS bias_pct FROM g JOIN auc USING (segment), whole""")
def segment_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.segments(scored(spark, sf), "segment")


@query(f"""WITH {SCORED_SQL}, q AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM scored), b AS (SELECT CAST(date_trunc('quarter', performance_date) AS DATE) AS period, len(list_filter(e, lambda x: x <= p)) AS band, y FROM scored, q),
g AS (SELECT period, band, count(*) AS c, avg(y) AS r FROM b GROUP BY 1, 2), d AS (SELECT *, r - lag(r) OVER (PARTITION BY period ORDER BY band) AS s FROM g)
SELECT period, sum(c)::BIGINT AS n, coalesce(bool_and(s >= -1e-12), true) AS monotone FROM d GROUP BY 1 HAVING sum(c) >= 800""")
def rank_order_stability(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rank_order(scored(spark, sf))


@query(f"""WITH {BOOK_SQL}, g AS (SELECT vintage, months_on_book, count(*) AS n, sum(default_flag) AS e FROM book WHERE months_on_book <= 84 GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY vintage) AS a, exp(sum(CASE WHEN e >= n THEN -800 ELSE ln(1 - e / n) END) OVER (PARTITION BY vintage ORDER BY months_on_book)) AS s FROM g)
SELECT vintage, months_on_book, n, round(100 * (1 - s), 8) AS cumulative_pct FROM s WHERE a >= 2000""")
def vintage_curves(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.vintage_curves(book(spark, sf))


@query(f"""WITH {SCORED_SQL} SELECT CAST(date_trunc('year', performance_date) AS DATE) AS period, count(*) AS n, round(avg(y), 8) AS actual, round(avg(p), 8) AS predicted FROM scored GROUP BY 1""")
def recohort_yearly(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy(exprs.period_of(F.col("performance_date"), "YS").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 8).alias("actual"), F.round(F.avg("p"), 8).alias("predicted"))


@query(f"""WITH {BOOK_SQL}, r AS (SELECT performance_date AS period, count(*) AS n, avg(lgd_realised) AS m, stddev_samp(lgd_realised) AS s FROM book WHERE lgd_realised IS NOT NULL GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM r), (SELECT max(period) FROM r), INTERVAL 1 MONTH)) AS DATE) AS period)
SELECT period, coalesce(n, 0)::BIGINT AS n, round(CASE WHEN n >= 5 THEN m END, 8) AS mean, round(CASE WHEN n >= 5 THEN m - 1.96 * s / sqrt(n) END, 8) AS low, round(CASE WHEN n >= 5 THEN m + 1.96 * s / sqrt(n) END, 8) AS high FROM sp LEFT JOIN r USING (period)""")
def severity_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.severity_over_time(book(spark, sf), "lgd_realised")


@query(f"""WITH {SCORED_SQL} SELECT round(min(s), 4) AS least, round(max(s), 4) AS most, round(avg(s), 4) AS mean FROM (SELECT 600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - p) / p) AS s FROM scored)""")
def scorecard_points(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).select(exprs.score_points(F.col("p")).alias("s"))
    return s.agg(F.round(F.min("s"), 4).alias("least"), F.round(F.max("s"), 4).alias("most"), F.round(F.avg("s"), 4).alias("mean"))


def curve_sql(edges: int, value: str, more: str) -> str:
    return f"q AS (SELECT list_distinct(quantile_cont({value}, [{', '.join(str(i / edges) for i in range(1, edges))}])) AS e FROM lines WHERE {more}), b AS (SELECT len(list_filter(e, lambda x: x <= {value}))::INT AS bucket, {value} AS value, y, lgd_realised FROM lines, q WHERE {more})"


@query(f"""WITH {LINES_SQL}, {curve_sql(30, "price", "price IS NOT NULL")}, g AS (SELECT bucket, count(*) AS n, sum(y) AS e, avg(value) AS x FROM b GROUP BY 1), o AS (SELECT *, ln((e + 0.5) / (n - e + 0.5)) AS lo, 1.959964 * sqrt(1 / (e + 0.5) + 1 / (n - e + 0.5)) AS h FROM g)
SELECT bucket, n, e::BIGINT AS events, round(x, 7) AS x, round(lo, 7) AS log_odds, round(lo - h, 7) AS low, round(lo + h, 7) AS high, round(avg(lo) OVER (ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 7) AS smooth FROM o""")
def log_odds_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curves.log_odds_curve(lines(spark, sf), "price", "y")


@query(f"""WITH {LINES_SQL}, g AS (SELECT coalesce(type, 'Missing') AS level, count(*) AS n, sum(y) AS e, row_number() OVER (ORDER BY count(*) DESC, coalesce(type, 'Missing')) AS i FROM lines GROUP BY 1)
SELECT CASE WHEN i <= 25 THEN level ELSE 'Other' END AS level, sum(n)::BIGINT AS n, sum(e)::BIGINT AS events, round(ln((sum(e) + 0.5) / (sum(n) - sum(e) + 0.5)), 7) AS log_odds FROM g GROUP BY 1""")
def categorical_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curves.categorical_curve(lines(spark, sf), "type", "y")


@query(f"""WITH {LINES_SQL}, {curve_sql(12, "price", "price IS NOT NULL AND lgd_realised IS NOT NULL")}
SELECT bucket, count(*) AS n, round(avg(value), 7) AS x, round(avg(lgd_realised), 8) AS mean, round(stddev_samp(lgd_realised) / sqrt(count(*)), 8) AS se FROM b GROUP BY 1 HAVING count(*) >= 30""")
def severity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return curves.severity_curve(lines(spark, sf), "price", "lgd_realised")


@query(f"""WITH {LINES_SQL} SELECT coalesce(segment, 'Missing') AS level, count(*) AS n, round(avg(lgd_realised), 8) AS mean, round(stddev_samp(lgd_realised) / sqrt(count(*)), 8) AS se FROM lines WHERE lgd_realised IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def severity_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return curves.severity_levels(lines(spark, sf), "segment", "lgd_realised")


@query(f"""WITH {BOOK_SQL} SELECT CASE WHEN lgd_realised <= 0 THEN 0 ELSE least(20, floor(lgd_realised * 20) + 1) END::INT AS bin, count(*) AS n, round(avg(lgd_realised), 8) AS mean FROM book WHERE lgd_realised IS NOT NULL GROUP BY 1""")
def severity_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return curves.severity_distribution(book(spark, sf), "lgd_realised")


@query(f"WITH {MACRO_SQL} SELECT key, month, round(value, 6) AS value FROM macro")
def macro_series(spark: SparkSession, sf: str) -> DataFrame:
    return panels.macro(spark, sf).withColumn("value", F.round("value", 6))


for _rule, _how in (("avg", "avg(value)"), ("sum", "sum(value)"), ("max", "max(value)"), ("eop", "arg_max(value, month)")):

    def _down(spark: SparkSession, sf: str, rule: str = _rule) -> DataFrame:
        return macro.down(panels.macro(spark, sf), rule)

    QUERIES[f"macro_down_{_rule}"] = _down
    ORACLE_SQL[f"macro_down_{_rule}"] = f"WITH {MACRO_SQL} SELECT key, CAST(date_trunc('quarter', month) AS DATE) AS period, count(*) AS n, round({_how}, 6) AS value FROM macro GROUP BY 1, 2"

TERMS_SQL = f"""{MACRO_SQL}, m1 AS (SELECT *, value - lag(value) OVER k AS diff, 100 * (value / nullif(lag(value, 12) OVER k, 0) - 1) AS yoy, ln(greatest(value, 1e-9)) - lag(ln(greatest(value, 1e-9))) OVER k AS log_diff, 100 * (pow(value / nullif(lag(value, 3) OVER k, 0), 4) - 1) AS qoq,
  (value - avg(value) OVER a) / CASE WHEN stddev_pop(value) OVER a = 0 THEN 1 ELSE stddev_pop(value) OVER a END AS z, value - lag(value, 12) OVER k AS fqc,
  CASE WHEN count(value) OVER r3 = 3 THEN avg(value) OVER r3 END AS ma3, CASE WHEN count(value) OVER r6 = 6 THEN avg(value) OVER r6 END AS ma6, CASE WHEN count(value) OVER r12 = 12 THEN avg(value) OVER r12 END AS ma12
  FROM macro WINDOW k AS (PARTITION BY key ORDER BY month), a AS (PARTITION BY key), r3 AS (PARTITION BY key ORDER BY month ROWS 2 PRECEDING), r6 AS (PARTITION BY key ORDER BY month ROWS 5 PRECEDING), r12 AS (PARTITION BY key ORDER BY month ROWS 11 PRECEDING)),
m2 AS (SELECT *, CASE WHEN count(yoy) OVER r3 = 3 THEN avg(yoy) OVER r3 END AS ym, CASE WHEN count(diff) OVER r3 = 3 THEN avg(diff) OVER r3 END AS dm FROM m1 WINDOW r3 AS (PARTITION BY key ORDER BY month ROWS 2 PRECEDING)),
terms AS ({" UNION ALL ".join(f"SELECT key, month, '{n}' AS transform, {c} AS value FROM m2" for n, c in zip(macro.TRANSFORMS, ["value", "diff", "yoy", "log_diff", "qoq", "z", "fqc", "ma3", "ma6", "ma12", "ym", "dm"], strict=True))})"""


@query(f"WITH {TERMS_SQL} SELECT key, month, transform, round(value, 5) AS value FROM terms")
def macro_transforms(spark: SparkSession, sf: str) -> DataFrame:
    return macro.transformed(panels.macro(spark, sf)).withColumn("value", F.round("value", 5))


@query(f"""WITH {TERMS_SQL}, {LINES_SQL.strip()}, c AS (SELECT key || '@' || transform || '@' || lag AS candidate, CAST(month + to_months(lag) AS DATE) AS month, value AS x FROM terms, (SELECT unnest([0, 3, 6]) AS lag) WHERE value IS NOT NULL),
t AS (SELECT performance_date AS month, ln(((sum(y) + 0.5) / (count(*) + 1)) / (1 - (sum(y) + 0.5) / (count(*) + 1))) AS y FROM lines GROUP BY 1 HAVING count(*) >= 500),
b AS (SELECT candidate, month, x - avg(x) OVER p AS dx, y - avg(y) OVER p AS dy FROM c JOIN t USING (month) WINDOW p AS (PARTITION BY candidate)),
d AS (SELECT *, dx * lag(dx) OVER s AS px, dy * lag(dy) OVER s AS py FROM b WINDOW s AS (PARTITION BY candidate ORDER BY month)),
g AS (SELECT candidate, count(*) AS n, sum(dx * dx) AS xx, sum(dy * dy) AS yy, sum(dx * dy) AS xy, sum(px) AS sx, sum(py) AS sy FROM d GROUP BY 1)
SELECT candidate, n, round(xy / sqrt(xx * yy), 7) AS r, round(greatest(4, n * (1 - greatest(-0.99, least(0.99, sx / xx * (sy / yy)))) / (1 + greatest(-0.99, least(0.99, sx / xx * (sy / yy))))), 4) AS n_effective FROM g WHERE n >= 24 AND xx > 1e-12 AND yy > 1e-12""")
def macro_library(spark: SparkSession, sf: str) -> DataFrame:
    candidates = macro.lagged(macro.transformed(panels.macro(spark, sf)), [0, 3, 6])
    return macro.candidate_correlations(candidates, macro.target_log_odds(lines(spark, sf), "y"))


@query(f"""WITH {MACRO_SQL}, g AS (SELECT key, month, 100 * (pow(value / lag(value) OVER k, 12) - 1) AS g FROM macro WHERE key = 'ticket' WINDOW k AS (PARTITION BY key ORDER BY month))
SELECT key, month, round(100 * exp(sum(ln(1 + g / 100) / 12) OVER (ORDER BY month)), 6) AS value FROM g WHERE g IS NOT NULL""")
def growth_to_level(spark: SparkSession, sf: str) -> DataFrame:
    growth = macro.growth_from_level(panels.macro(spark, sf).filter("key = 'ticket'"), 12).filter("value IS NOT NULL")
    return macro.level_from_growth(growth, 12).withColumn("value", F.round("value", 6))


@query(f"""WITH {MACRO_SQL}, f AS (SELECT key, CAST(month + INTERVAL 24 MONTH AS DATE) AS month, value * 1.1 AS value FROM macro WHERE month >= DATE '1999-01-01' AND month < DATE '2000-01-01'),
s AS (SELECT key, min(month) AS st, arg_min(value, month) AS fv FROM f GROUP BY 1), h AS (SELECT m.* FROM macro m JOIN s USING (key) WHERE m.month < st), l AS (SELECT key, arg_max(value, month) AS lv FROM h GROUP BY 1)
SELECT key, month, round(value, 5) AS value, false AS projected FROM h UNION ALL SELECT f.key, f.month, round(f.value * CASE WHEN key IN ('sales', 'orders') THEN lv / fv ELSE 1 END, 5), true FROM f JOIN s USING (key) JOIN l USING (key)""")
def scenario_splice(spark: SparkSession, sf: str) -> DataFrame:
    m = panels.macro(spark, sf)
    path = m.filter("month >= DATE'1999-01-01' AND month < DATE'2000-01-01'").select("key", F.add_months("month", 24).alias("month"), (F.col("value") * 1.1).alias("value"))
    return macro.spliced(m, path, ["sales", "orders"]).withColumn("value", F.round("value", 5))


@query(f"""WITH {MACRO_SQL}, g AS (SELECT key, min(value) FILTER (WHERE month <= DATE '1999-12-01') AS lo, max(value) FILTER (WHERE month <= DATE '1999-12-01') AS hi, stddev_pop(value) FILTER (WHERE month <= DATE '1999-12-01') AS sd,
  min(value) FILTER (WHERE month > DATE '1999-12-01') AS a, max(value) FILTER (WHERE month > DATE '1999-12-01') AS b FROM macro GROUP BY 1)
SELECT key, round(lo, 6) AS lo, round(hi, 6) AS hi, round(greatest(0, b - hi, lo - a) / nullif(sd, 0), 6) AS sd_beyond FROM g""")
def extrapolation_check(spark: SparkSession, sf: str) -> DataFrame:
    return macro.extrapolation(panels.macro(spark, sf), "1999-12-01")


@query()
def denton_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    quarters = macro.down(panels.macro(spark, sf), "sum")
    return macro.benchmarked(quarters.select("key", "period", "value"), "sum").withColumn("value", F.round("value", 4))


@query()
def unit_root_tests(spark: SparkSession, sf: str) -> DataFrame:
    return macro.stationarity(panels.macro(spark, sf))


@query("""SELECT CAST(date_trunc('month', ts) AS DATE) AS period, event_type AS key, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")
def events_to_monthly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("month"), "value")
    return macro.down(e, "avg", "MS")



def given_pd() -> Column:
    return (20 + 4 * (F.col("account_id") % 25)) / F.lit(10000.0) * (1 + F.col("t") / F.lit(100.0))


def given_lgd() -> Column:
    return (20 + F.col("account_id") % 50) / F.lit(100.0)


SCENARIOS = [("base", 1.0, 1.0, 1.0), ("stressed", 2.4, 1.25, 1.08)]
HORIZON = 24


def projected(spark: SparkSession, sf: str) -> DataFrame:
    return losses.projection(losses.open_book(book(spark, sf)), given_pd(), given_lgd(), HORIZON, SCENARIOS)


PROJ_SQL = f"""{BOOK_SQL}, ob AS (SELECT *, interest_rate / 12 AS r FROM book QUALIFY performance_date = max(performance_date) OVER (PARTITION BY account_id) AND max(default_flag) OVER (PARTITION BY account_id) = 0),
ex AS (SELECT ob.*, sc.*, unnest(generate_series(1, {HORIZON})) AS t FROM ob, (VALUES {", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for s, a, b, c in SCENARIOS)}) sc(scenario, m_pd, m_lgd, m_ead)),
p0 AS (SELECT scenario, account_id, t, segment, current_balance, least(0.999, (20 + 4 * (account_id % 25)) / 10000.0::DOUBLE * (1 + t / 100.0::DOUBLE) * m_pd) AS pd, least(1, (20 + account_id % 50) / 100.0::DOUBLE * m_lgd) AS lgd,
  CASE WHEN t >= remaining_term THEN 0 ELSE greatest(0, current_balance * pow(1 + r, t) - current_balance * r / (1 - pow(1 + r, -remaining_term)) * (pow(1 + r, t) - 1) / r) END * m_ead AS ead, pow(1 + r, -t) AS df FROM ex),
proj AS (SELECT *, coalesce(exp(sum(ln(1 - pd)) OVER (PARTITION BY scenario, account_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS survival FROM p0)"""
LOSS = "pd * survival * lgd * ead * df"


def losses_sql(by: str) -> str:
    return f"WITH {PROJ_SQL} SELECT {by}, round(sum({LOSS}), 4) AS ecl, round(sum({LOSS}) FILTER (WHERE t <= 12), 4) AS ecl_12, count(*) FILTER (WHERE t = 1) AS accounts, round(sum(current_balance) FILTER (WHERE t = 1), 2) AS exposure FROM proj GROUP BY {by}"


@query(losses_sql("scenario"))
def expected_loss(spark: SparkSession, sf: str) -> DataFrame:
    return losses.losses(projected(spark, sf))


@query(losses_sql("scenario, segment"))
def expected_loss_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return losses.losses(projected(spark, sf), ["scenario", "segment"])


@query(f"""WITH {PROJ_SQL}, m AS (SELECT scenario, t, sum({LOSS}) AS l, avg(survival) AS s, sum(ead) AS e FROM proj GROUP BY 1, 2)
SELECT scenario, t::INT AS t, round(l, 4) AS loss, round(sum(l) OVER (PARTITION BY scenario ORDER BY t), 4) AS cumulative_loss, round(s, 8) AS survival, round(e, 2) AS exposure FROM m""")
def loss_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return losses.monthly(projected(spark, sf))


@query(f"""WITH {PROJ_SQL}, a AS (SELECT scenario, account_id, sum({LOSS}) AS ecl, sum({LOSS}) FILTER (WHERE t <= 12) AS e12, 1 - exp(sum(ln(1 - pd)) FILTER (WHERE t <= 12)) AS pd12, max(current_balance) AS b FROM proj GROUP BY 1, 2),
m AS (SELECT scenario, median(pd12) AS md FROM a GROUP BY 1), s AS (SELECT *, CASE WHEN pd12 > 2 * greatest(md, 1e-9) OR pd12 > 0.005 THEN 2 ELSE 1 END AS stage FROM a JOIN m USING (scenario))
SELECT scenario, stage::INT AS stage, count(*) AS n, round(sum(b), 2) AS exposure, round(sum(CASE WHEN stage = 1 THEN e12 ELSE ecl END), 4) AS ecl FROM s GROUP BY 1, 2""")
def staging(spark: SparkSession, sf: str) -> DataFrame:
    return losses.staged(projected(spark, sf))


PAIR_SQL = f"{PROJ_SQL}, pr AS (SELECT b.pd AS bpd, b.survival AS bsurvival, b.lgd AS blgd, b.ead AS bead, b.df AS df, s.pd AS spd, s.survival AS ssurvival, s.lgd AS slgd, s.ead AS sead FROM proj b JOIN proj s USING (account_id, t) WHERE b.scenario = 'base' AND s.scenario = 'stressed')"


def value_sql(stressed: str) -> str:
    return "sum(df * " + " * ".join(f"{'s' if f in stressed.split() else 'b'}{f}" for f in losses.FACTORS) + ")"


@query(f"""WITH {PAIR_SQL}, e AS (SELECT {value_sql("")} AS e0, {value_sql("pd")} AS e1, {value_sql("pd survival")} AS e2, {value_sql("pd survival lgd")} AS e3, {value_sql("pd survival lgd ead")} AS e4 FROM pr)
SELECT step::INT AS step, label, round(delta, 4) AS delta, round(running, 4) AS running FROM (
  SELECT 0 AS step, 'base' AS label, e0 AS delta, e0 AS running FROM e UNION ALL SELECT 1, 'pd', e1 - e0, e1 FROM e UNION ALL SELECT 2, 'survival', e2 - e1, e2 FROM e UNION ALL SELECT 3, 'lgd', e3 - e2, e3 FROM e
  UNION ALL SELECT 4, 'ead', e4 - e3, e4 FROM e UNION ALL SELECT 5, 'interaction', 0, e4 FROM e UNION ALL SELECT 6, 'stressed', e4, e4 FROM e)""")
def attribution_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return losses.bridge(projected(spark, sf), "base", "stressed")


def _shapley_sql() -> str:
    from math import factorial

    subsets = [s for k in range(5) for s in combinations(losses.FACTORS, k)]
    name = lambda s: "v_" + "_".join(s)
    parts = []
    for f in losses.FACTORS:
        terms = [f"{factorial(len(s)) * factorial(3 - len(s)) / 24}::DOUBLE * ({name([x for x in losses.FACTORS if x in s or x == f])} - {name(s)})" for s in subsets if f not in s]
        parts.append(f"SELECT '{f}' AS factor, round({' + '.join(terms)}, 4) AS contribution FROM v")
    return f"WITH {PAIR_SQL}, v AS (SELECT {', '.join(f'{value_sql(" ".join(s))} AS {name(s)}' for s in subsets)} FROM pr) " + " UNION ALL ".join(parts)


@query(_shapley_sql())
def attribution_shapley(spark: SparkSession, sf: str) -> DataFrame:
    return losses.shapley(projected(spark, sf), "base", "stressed")


SHOCKS = {"pd +10 %": (1.1, 1, 1), "lgd +10 %": (1, 1.1, 1), "ead +10 %": (1, 1, 1.1), "pd -10 %": (0.9, 1, 1)}


def _tornado_sql() -> str:
    shocks = [("", 1, 1, 1), *[(k, *v) for k, v in SHOCKS.items()]]
    proj = PROJ_SQL.replace(", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for s, a, b, c in SCENARIOS), ", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for s, a, b, c in shocks))
    return f"""WITH {proj}, e AS (SELECT scenario, round(sum({LOSS}), 4) AS ecl FROM proj GROUP BY 1), d AS (SELECT scenario AS shock, round(ecl - (SELECT ecl FROM e WHERE scenario = ''), 4) AS delta FROM e WHERE scenario <> '')
SELECT shock, delta, row_number() OVER (ORDER BY abs(delta) DESC, shock)::INT AS place FROM d"""


@query(_tornado_sql())
def tornado(spark: SparkSession, sf: str) -> DataFrame:
    return losses.tornado(losses.open_book(book(spark, sf)), given_pd(), given_lgd(), HORIZON, SHOCKS)


@query(f"""WITH {BOOK_SQL}, j AS (SELECT d.current_balance AS a, h.current_balance AS b, h.committed_amount AS l FROM book d JOIN book h ON d.account_id = h.account_id AND h.performance_date = CAST(d.performance_date - INTERVAL 12 MONTH AS DATE) WHERE d.default_flag = 1 AND h.committed_amount > h.current_balance)
SELECT count(*) AS n, round(avg(greatest(0, least(1, (a - b) / (l - b)))), 8) AS ccf FROM j""")
def credit_conversion(spark: SparkSession, sf: str) -> DataFrame:
    return losses.ccf(book(spark, sf))


@query(f"""WITH {PROJ_SQL}, r AS (SELECT scenario, segment AS book, sum({LOSS}) AS e, sum(current_balance) FILTER (WHERE t = 1) AS x FROM proj GROUP BY 1, 2),
k AS (SELECT scenario, book, round(sum(round(e, 4)), 4) AS ecl, round(sum(round(x, 2)), 2) AS exposure FROM r GROUP BY ROLLUP (scenario, book) HAVING scenario IS NOT NULL)
SELECT scenario, book, ecl, exposure FROM k UNION ALL SELECT 'weighted', book, round(sum(ecl * CASE scenario WHEN 'base' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) / 1, 4), max(exposure) FROM k GROUP BY book""")
def firm_rollup(spark: SparkSession, sf: str) -> DataFrame:
    by = losses.losses(projected(spark, sf), ["scenario", "segment"]).withColumnRenamed("segment", "book")
    return losses.firm_rollup(by, {"base": 0.7, "stressed": 0.3})


BOUNDARY = "2000-01-01"
TREATMENTS = {"months_on_book": "hinges", "current_balance": "scaled", "segment": "woe_levels", "c_acctbal": "woe"}


def _coefficients(spark: SparkSession, model: estimate.Model) -> DataFrame:
    rows = [(n, *(None if v is None else round(float(v), 6) for v in r)) for n, *r in model.table()]
    return spark.createDataFrame(rows, "term string, beta double, se double, z double, p_value double")


@query()
def fit_default_model(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, search.model_run(book(spark, sf), "default_flag", TREATMENTS, BOUNDARY)[0])


@query()
def model_slices(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.discrimination(search.model_run(book(spark, sf), "default_flag", TREATMENTS, BOUNDARY)[1], ["slice"])


@query()
def fit_severity_model(spark: SparkSession, sf: str) -> DataFrame:
    seen = book(spark, sf).filter("default_flag = 1 AND lgd_realised IS NOT NULL")
    return _coefficients(spark, estimate.fit_logistic(seen, "lgd_realised", {"months_on_book": "scaled", "current_balance": "scaled"}, robust=True))


@query()
def forward_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.forward(book(spark, sf), "default_flag", {"months_on_book": "scaled", "current_balance": "scaled", "segment": "woe_levels"}, most=2)
    return spark.createDataFrame([(i + 1, c, round(p, 8)) for i, (c, p) in enumerate(found)] or [(0, "", 1.0)], "step int, term string, p_value double")


@query()
def combination_fits(spark: SparkSession, sf: str) -> DataFrame:
    combos = {"+".join(c): list(c) for k in (1, 2) for c in combinations(NUMERIC, k)}
    return search.joint_fits(lines(spark, sf), "y", combos)


@query("""WITH r AS (SELECT c_custkey AS id, 0.6 + (c_custkey % 17) / 100.0::DOUBLE AS auc_in, CASE WHEN c_custkey % 5 <> 0 THEN 0.58 + (c_custkey % 13) / 100.0::DOUBLE END AS auc_oot, c_custkey % 3 = 0 AS sig, c_custkey % 4 <> 1 AS mono, c_custkey % 7 = 2 AS shifted, 1 + (c_custkey % 23)::DOUBLE AS vif, c_custkey % 11 = 0 AS filtered FROM customer),
l AS (SELECT *, coalesce(auc_oot, auc_in) AS a FROM r WHERE NOT filtered), e AS (SELECT min(a) AS lo, max(a) AS hi FROM l),
s AS (SELECT id, round(0.30::DOUBLE * (a - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END + 0.15::DOUBLE * sig::INT + 0.15::DOUBLE * mono::INT + 0.10::DOUBLE * (NOT shifted)::INT
  + 0.20::DOUBLE * CASE WHEN vif <= 5 THEN 1 WHEN vif <= 10 THEN (10 - vif) / 5 ELSE greatest(-1, -(vif - 10) / 10) END + 0.10::DOUBLE * greatest(0, 1 - greatest(0, auc_in - a) / 0.10::DOUBLE), 10) AS score FROM l, e)
SELECT r.id::VARCHAR AS hash, round(score, 8) + 0::DOUBLE AS score, k AS auto_rank FROM r LEFT JOIN (SELECT *, row_number() OVER (ORDER BY score DESC, id::VARCHAR)::INT AS k FROM s) USING (id)""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.cast("string").alias("hash"), (0.6 + (k % 17) / F.lit(100.0)).alias("auc_in"), F.when(k % 5 != 0, 0.58 + (k % 13) / F.lit(100.0)).alias("auc_oot"), (k % 3 == 0).alias("all_significant"), (k % 4 != 1).alias("stress_monotone"),
        (k % 7 == 2).alias("core_shifted"), (1 + k % 23).cast("double").alias("max_vif"), (k % 11 == 0).alias("filtered"),
    )
    return specs.composite_rank(rows).select("hash", (F.round("score", 8) + 0.0).alias("score"), "auto_rank")


def seller_tape(spark: SparkSession, sf: str) -> DataFrame:
    """orders as a seller would send them, with planted faults."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("L"), (k - k % 7).cast("string")).alias("LoanNumber"), F.when(k % 97 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("AsOfDate"),
        F.when(k % 50 == 1, F.lit(None)).when(k % 31 == 0, "2").otherwise((F.col("o_orderstatus") == "F").cast("int").cast("string")).alias("DefaultInd"), F.col("o_totalprice").cast("string").alias("UPB"),
    )


@query("""WITH t AS (SELECT 'L' || (o_orderkey - o_orderkey % 7) AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS m, o_orderkey % 97 = 0 AS bad,
  CASE WHEN o_orderkey % 50 = 1 THEN NULL WHEN o_orderkey % 31 = 0 THEN 2 ELSE (o_orderstatus = 'F')::INT END AS f FROM orders)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE bad) AS bad_dates, count(*) FILTER (WHERE f = 2) AS bad_flags, count(*) FILTER (WHERE f IS NULL) AS null_flags, count(*) - (SELECT count(*) FROM (SELECT DISTINCT id, m FROM t)) AS repeated_keys FROM t""")
def tape_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = seller_tape(spark, sf)
    return tape.gate(tape.mapped(df, tape.suggest_mapping(df.columns)))


@query("""WITH t AS (SELECT 'L' || (o_orderkey - o_orderkey % 7) AS a, CASE WHEN o_orderkey % 50 = 1 THEN NULL WHEN o_orderkey % 31 = 0 THEN '2' ELSE ((o_orderstatus = 'F')::INT)::VARCHAR END AS d FROM orders)
SELECT 'LoanNumber' AS column_name, 'string' AS type, count(DISTINCT a) AS n_unique, 0::BIGINT AS missing, false AS numbers_as_text FROM t
UNION ALL SELECT 'DefaultInd', 'string', count(DISTINCT d), count(*) FILTER (WHERE d IS NULL), false FROM t""")
def tape_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tape.column_report(seller_tape(spark, sf).select("LoanNumber", "DefaultInd"))


@query("""SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return panel_stream.windowed_counts(table(spark, sf, "events"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return panel_stream.sessions(table(spark, sf, "events"))


from . import fit_queries, panel_queries, scenario_queries, screening_queries, severity_queries  # noqa: E402, F401  register their queries beside these
