"""Queries of the macro panel by catalogue, of growth by its level and of stored books, with their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import benchmarking, macro, macro_catalogue
from ..operators.macro_catalogue import Entry
from ..session import shared_dir
from ..sources import books, panels
from ..sources.panels import BOOK_SQL, MACRO_SQL, book, table
from .queries import query


def straight_sql(view: str, of: str, value: str, to: str) -> str:
    """of: columns of the view. Nulls of value on the line between the values around them."""
    at = "(12 * year(month) + month(month))"
    known = f"CASE WHEN {value} IS NOT NULL THEN {{'at': {at}, 'x': {value}}} END"
    return f"""(SELECT {of}, coalesce(a.x + (b.x - a.x) * coalesce(({at} - a.at) / nullif(b.at - a.at, 0), 0), a.x, b.x) AS {to} FROM (
  SELECT *, last_value({known} IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) AS a, first_value({known} IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {view}))"""


#: Every seventh month of the indicator is missing.
GROWTH_SQL = f"""{MACRO_SQL}, q AS (SELECT key, CAST(date_trunc('quarter', month) AS DATE) AS period, arg_max(value, month) AS v FROM macro WHERE key IN ('ticket', 'urgent_share') GROUP BY 1, 2 HAVING count(*) = 3),
g AS (SELECT key, period, 100 * (pow(v / lag(v) OVER (PARTITION BY key ORDER BY period), 4) - 1) AS g FROM q), gr AS (SELECT * FROM g WHERE g IS NOT NULL),
l AS (SELECT key, period, 100 * exp(sum(ln(1 + g / 100) / 4) OVER (PARTITION BY key ORDER BY period)) AS v FROM gr),
mon AS (SELECT key, CAST(unnest(generate_series(min(period), max(period) + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM l GROUP BY key),
iz AS (SELECT mon.key, mon.month, i.value AS z0 FROM mon LEFT JOIN (SELECT month, value FROM macro WHERE key = 'sales' AND month(month) <> 7) i ON mon.key = 'ticket' AND mon.month = i.month),
zz AS (SELECT key, month, coalesce(z, 1) AS z FROM {straight_sql("iz", "key, month", "z0", "z")}),
u0 AS (SELECT zz.*, l.v / z AS u0 FROM zz LEFT JOIN l ON l.key = zz.key AND CAST(l.period + INTERVAL 2 MONTH AS DATE) = zz.month),
lev AS (SELECT key, month, u * z AS level FROM {straight_sql("u0", "key, month, z", "u0", "u")}),
gm AS (SELECT key, month, level, 100 * (pow(level / coalesce(lag(level) OVER (PARTITION BY key ORDER BY month), 100), 12) - 1) AS value FROM lev)"""


def quarterly_growth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Growth of two series by whole quarters, and an indicator with gaps for one of them."""
    m = panels.macro(spark, sf)
    whole = macro.down(m.filter("key IN ('ticket', 'urgent_share')"), "eop").filter("n = 3")
    eop = m.groupBy("key", F.trunc("month", "quarter").alias("month")).agg(F.max_by("value", "month").alias("value"))
    level = whole.select("key", F.col("period").alias("month")).join(eop, ["key", "month"])
    growth = macro.growth_from_level(level, 4).filter("value IS NOT NULL")
    indicator = m.filter("key = 'sales' AND month(month) != 7").select(F.lit("ticket").alias("key"), "month", "value")
    return growth.select("key", F.col("month").alias("period"), "value"), indicator


@query(f"WITH {GROWTH_SQL} SELECT key, month, round(level, 5) AS level, round(value, 3) AS value FROM gm")
def growth_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly growth of quarterly growth series by way of their levels."""
    found = benchmarking.growth_by_level(*quarterly_growth(spark, sf))
    return found.select("key", "month", F.round("level", 5).alias("level"), F.round("value", 3).alias("value"))


@query(f"""WITH {GROWTH_SQL}, s AS (SELECT zz.key, zz.month, level / z AS u FROM lev JOIN zz USING (key, month)),
d AS (SELECT key, month, u / lag(u) OVER w - 1 AS d1, lead(u) OVER w - 2 * u + lag(u) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY key ORDER BY month))
SELECT d.key, count(*) AS months, round(max(abs(v - level) / level), 8) AS worst_gap, count(*) FILTER (WHERE abs(d2) > 1e-9 AND month(d.month) % 3 <> 0) AS bends, round(sum(d1 * d1), 8) AS roughness
FROM d LEFT JOIN l ON l.key = d.key AND CAST(l.period + INTERVAL 2 MONTH AS DATE) = d.month LEFT JOIN lev ON lev.key = d.key AND lev.month = l.period + INTERVAL 2 MONTH GROUP BY 1""")
def growth_benchmark_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether levels meet the published ones, and how far the ratio to the indicator bends within quarters: nowhere."""
    growth, indicator = quarterly_growth(spark, sf)
    level = macro.level_from_growth(growth.withColumnRenamed("period", "month"), 4).select("key", F.add_months("month", 2).alias("month"), F.col("value").alias("v"))
    rows = benchmarking.growth_by_level(growth, indicator).join(benchmarking.on_months(growth, indicator), ["key", "month"]).join(level, ["key", "month"], "left")
    w, u = Window.partitionBy("key").orderBy("month"), F.col("level") / F.col("z")
    rows = rows.withColumns({"d1": u / F.lag(u).over(w) - 1, "d2": F.lead(u).over(w) - 2 * u + F.lag(u).over(w)})
    bend = (F.abs("d2") > 1e-9) & (F.month("month") % 3 != 0)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("months"), F.round(F.max(F.abs(F.col("v") - F.col("level")) / F.col("level")), 8).alias("worst_gap"), F.count_if(bend).alias("bends"), F.round(F.sum(F.col("d1") * F.col("d1")), 8).alias("roughness"))


CATALOGUE = [
    Entry("event_value", "Mean value of events", "D", "stock", "rate", "avg"),
    Entry("event_peak", "Most events of a day", "D", "flow", "level", "max"),
    Entry("week_sales", "Orders by week", "W", "flow", "level", "sum"),
    Entry("ticket", "Last month's mean order", "M", "stock", "index", "eop", rebase=True),
    Entry("sales", "Orders by month", "M", "flow", "growth", "sum", derive=True),
    Entry("quarter_ticket", "Mean order at the end of a quarter", "Q", "stock", "index", "eop", indicator="ticket"),
    Entry("absent", "A series without history", "M", "stock", "rate", "avg"),
]


def mixed_history(spark: SparkSession, sf: str) -> DataFrame:
    """key, date and value of series of four frequencies, from events and orders."""
    e, o = table(spark, sf, "events"), table(spark, sf, "orders")
    m = panels.macro(spark, sf)
    daily = e.groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("event_value"), F.count(F.lit(1)).cast("double").alias("event_peak"))
    weekly = o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).agg(F.sum("o_totalprice").alias("value"))
    quarterly = m.filter("key = 'ticket'").groupBy(F.trunc("month", "quarter").alias("date")).agg(F.max_by("value", "month").alias("value"), F.count(F.lit(1)).alias("n")).filter("n = 3")
    parts = [panels.unpivoted(daily, ["event_value", "event_peak"], "date").withColumnRenamed("name", "key"), weekly.withColumn("key", F.lit("week_sales")), m.filter("key IN ('ticket', 'sales')").withColumnRenamed("month", "date"), quarterly.withColumn("key", F.lit("quarter_ticket"))]
    out = None
    for p in parts:
        own = p.select("key", "date", "value")
        out = own if out is None else out.unionByName(own)
    return out


MIXED_SQL = f"""{MACRO_SQL}, dy AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS event_value, count(*)::DOUBLE AS event_peak FROM events GROUP BY 1),
qt AS (SELECT CAST(date_trunc('quarter', month) AS DATE) AS period, arg_max(value, month) AS v FROM macro WHERE key = 'ticket' GROUP BY 1 HAVING count(*) = 3),
hist AS (SELECT 'event_value' AS key, date, event_value AS value FROM dy UNION ALL SELECT 'event_peak', date, event_peak FROM dy UNION ALL SELECT 'week_sales', CAST(date_trunc('week', o_orderdate) AS DATE), sum(o_totalprice) FROM orders GROUP BY 2
  UNION ALL SELECT key, month, value FROM macro WHERE key IN ('ticket', 'sales') UNION ALL SELECT 'quarter_ticket', period, v FROM qt)"""


@query(f"""WITH {MIXED_SQL}, c AS (SELECT * FROM (VALUES ('event_value', 'D', 'avg'), ('event_peak', 'D', 'max'), ('week_sales', 'W', 'sum'), ('ticket', 'M', 'eop'), ('sales', 'M', 'sum'), ('quarter_ticket', 'Q', 'eop'), ('absent', 'M', 'avg')) v(key, native, agg))
SELECT key, native, agg, count(value) AS n, min(date) AS first, max(date) AS last, CASE WHEN count(value) > 0 THEN 'ok' ELSE 'missing' END AS status FROM c LEFT JOIN hist USING (key) GROUP BY 1, 2, 3""")
def macro_catalogue_status(spark: SparkSession, sf: str) -> DataFrame:
    """What the history has of each series of a catalogue."""
    return macro_catalogue.resolved(macro_catalogue.table_of(spark, CATALOGUE), mixed_history(spark, sf)).select("key", "native", "agg", "n", "first", "last", "status")


@query(f"""WITH {MIXED_SQL}, mo2 AS (SELECT key, CAST(date_trunc('month', date) AS DATE) AS month, CASE key WHEN 'event_value' THEN avg(value) WHEN 'event_peak' THEN max(value) WHEN 'ticket' THEN arg_max(value, date) ELSE sum(value) END AS value FROM hist WHERE key <> 'quarter_ticket' GROUP BY 1, 2),
mon AS (SELECT 'quarter_ticket' AS key, CAST(unnest(generate_series(min(period), max(period) + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM qt),
u0 AS (SELECT mon.key, mon.month, m.value AS z, qt.v / m.value AS u0 FROM mon JOIN mo2 m ON m.key = 'ticket' AND m.month = mon.month LEFT JOIN qt ON CAST(qt.period + INTERVAL 2 MONTH AS DATE) = mon.month),
lev AS (SELECT * FROM mo2 UNION ALL SELECT key, month, u * z FROM {straight_sql("u0", "key, month, z", "u0", "u")}),
gr AS (SELECT key, month, 100 * (pow(value / nullif(lag(value, 3) OVER (PARTITION BY key ORDER BY month), 0), 4) - 1) AS value FROM lev WHERE key = 'sales')
SELECT CASE WHEN key = 'sales' THEN 'sales_level' ELSE key END AS key, month, round(value, 4) AS value FROM lev UNION ALL SELECT key, month, round(value, 4) FROM gr WHERE value IS NOT NULL""")
def macro_panel_by_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Daily, weekly, monthly and quarterly series on months, each by its row of the catalogue."""
    return macro_catalogue.panel(mixed_history(spark, sf), macro_catalogue.table_of(spark, CATALOGUE)).withColumn("value", F.round("value", 4))


@query(f"""WITH {BOOK_SQL} SELECT account_id, count(*) AS months, round(max(current_balance - coalesce(before, 0)), 2) AS greatest_rise, min(segment) AS segment, round(min(c_acctbal), 2) AS c_acctbal
FROM (SELECT *, lag(current_balance) OVER (PARTITION BY account_id ORDER BY performance_date) AS before FROM book) GROUP BY 1""")
def bucketed_book(spark: SparkSession, sf: str) -> DataFrame:
    """A book stored in buckets and opened again: its windows, joins and groups by account move no rows."""
    store = books.Store(spark, f"{shared_dir(spark)}/riskpanel/{uuid.uuid4().hex}")
    store.save("book", book(spark, sf))
    w = Window.partitionBy("account_id").orderBy("performance_date")
    rise = F.col("current_balance") - F.coalesce(F.lag("current_balance").over(w), F.lit(0.0))
    return store.frame("book").withColumn("rise", rise).groupBy("account_id").agg(F.count(F.lit(1)).alias("months"), F.round(F.max("rise"), 2).alias("greatest_rise"), F.min("segment").alias("segment"), F.round(F.min("c_acctbal"), 2).alias("c_acctbal"))
