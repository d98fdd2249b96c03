"""Sources: tables by name, and the credit panels that are derived from the test tables.

book: one row per account and month up to its first default. lines: a wide screening frame at the grain of order lines.
macro: monthly series in long form. Each has its SQL for DuckDB beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_index, month_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table without the columns that hold hidden truth."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.drop(*[c for c in df.columns if c.startswith("_truth")])


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, performance_date, default_flag, months_on_book, vintage, origination_date, balances, rates, drivers and severity.

    All grouping and windows are by account, so the orders are shuffled once.
    """
    orders = table(spark, sf_dir, "orders")
    o = orders.select(
        F.col("o_custkey").alias("account_id"), month_of(F.col("o_orderdate")).alias("m"), F.col("o_totalprice").alias("price"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("bad"),
    ).repartition("account_id")
    months = o.groupBy("account_id", "m").agg(F.sum("price").alias("spent"), F.max("bad").alias("bad"))
    ends = months.groupBy("account_id").agg(F.min("m").alias("origination_date"), F.max("m").alias("last"), F.min(F.when(F.col("bad"), F.col("m"))).alias("bad_m"))
    spine = ends.select("account_id", "origination_date", "bad_m", F.explode(F.expr("sequence(origination_date, least(last, coalesce(bad_m, last)), interval 1 month)")).alias("performance_date"))
    rows = spine.join(months.select("account_id", F.col("m").alias("performance_date"), "spent"), ["account_id", "performance_date"], "left")
    w = Window.partitionBy("account_id").orderBy("performance_date")
    spent = F.coalesce("spent", F.lit(0.0))
    rows = rows.withColumn("current_balance", F.round(F.sum(spent).over(w.rowsBetween(-2, 0)), 2)).withColumn("committed_amount", F.max("current_balance").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), "c_acctbal", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    flag = F.coalesce((F.col("performance_date") == F.col("bad_m")).cast("int"), F.lit(0))
    mob = (month_index(F.col("performance_date")) - month_index(F.col("origination_date"))).cast("int")
    return rows.join(customer, "account_id", "left").select(
        "account_id", "performance_date", flag.alias("default_flag"), mob.alias("months_on_book"), F.year("origination_date").alias("vintage"), "origination_date",
        "current_balance", "committed_amount", (0.03 + 0.01 * (F.col("nation") % 7)).alias("interest_rate"), F.greatest(F.lit(1), 60 - mob).alias("remaining_term"),
        "c_acctbal", "segment", "nation", F.when(flag == 1, (F.col("account_id") * 37 % 101) / 100.0).alias("lgd_realised"),
    )


BOOK_SQL = """
bo AS (SELECT o_custkey AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(o_totalprice) AS spent, bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS bad FROM orders GROUP BY 1, 2),
be AS (SELECT account_id, min(m) AS origination_date, max(m) AS last, min(m) FILTER (WHERE bad) AS bad_m FROM bo GROUP BY 1),
bs AS (SELECT account_id, origination_date, bad_m, CAST(unnest(generate_series(origination_date, least(last, coalesce(bad_m, last)), INTERVAL 1 MONTH)) AS DATE) AS performance_date FROM be),
bw AS (SELECT bs.*, round(sum(coalesce(spent, 0)) OVER (PARTITION BY bs.account_id ORDER BY performance_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS current_balance
       FROM bs LEFT JOIN bo ON bs.account_id = bo.account_id AND performance_date = m),
book AS (
  SELECT account_id, performance_date, coalesce((performance_date = bad_m)::INT, 0) AS default_flag,
         (12 * (year(performance_date) - year(origination_date)) + month(performance_date) - month(origination_date))::INT AS months_on_book,
         year(origination_date)::INT AS vintage, origination_date, current_balance,
         max(current_balance) OVER (PARTITION BY account_id ORDER BY performance_date ROWS UNBOUNDED PRECEDING) AS committed_amount,
         0.03::DOUBLE + 0.01::DOUBLE * (c_nationkey % 7) AS interest_rate,
         greatest(1, 60 - (12 * (year(performance_date) - year(origination_date)) + month(performance_date) - month(origination_date)))::INT AS remaining_term,
         c_acctbal, c_mktsegment AS segment, c_nationkey AS nation, CASE WHEN performance_date = bad_m THEN (account_id * 37 % 101) / 100.0::DOUBLE END AS lgd_realised
  FROM bw LEFT JOIN customer ON account_id = c_custkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """performance_date, y, numeric drivers, categorical drivers, lgd_realised, exposure. It has no row key."""
    t = lambda n: table(spark, sf_dir, n)
    li, o, p, s, c = t("lineitem"), t("orders"), t("part"), t("supplier"), t("customer")
    y = (F.col("l_returnflag") == "R").cast("int")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(
        month_of(F.col("l_shipdate")).alias("performance_date"), y.alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.when(F.col("l_tax") != 0.08, F.col("l_tax")).alias("tax"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"),
        F.col("s_acctbal").alias("supplier_balance"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.when(y == 1, F.least(F.lit(1.0), 10 * F.col("l_discount"))).alias("lgd_realised"), F.col("l_extendedprice").alias("exposure"),
    )


NUMERIC = ["quantity", "price", "discount", "tax", "size", "retail", "supplier_balance"]
CATEGORICAL = ["type", "brand", "priority", "segment"]

LINES_SQL = """
lines AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS performance_date, (l_returnflag = 'R')::INT AS y, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         nullif(l_tax, 0.08::DOUBLE) AS tax, p_size::DOUBLE AS size, p_retailprice AS retail, s_acctbal AS supplier_balance, p_type AS type, p_brand AS brand, o_orderpriority AS priority,
         c_mktsegment AS segment, CASE WHEN l_returnflag = 'R' THEN least(1, 10 * l_discount) END AS lgd_realised, l_extendedprice AS exposure
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def unpivoted(df: DataFrame, columns: list[str], *keep: str, names: list[str] | None = None) -> DataFrame:
    """One row per row and column: keep, name (the column's, or that in names), value (null where the column is)."""
    pairs = zip(names or columns, columns, strict=True)
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in pairs])).alias("x")).select(*keep, "x.name", "x.value")


def unpivot_sql(view: str, columns: list[str], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS name, {c} AS value FROM {view}" for c in columns)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series in long form (key, month, value): count, total and mean of orders, and urgent share in percent."""
    o = table(spark, sf_dir, "orders")
    urgent = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")) * 100
    m = o.groupBy(month_of(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("sales"), F.avg("o_totalprice").alias("ticket"), urgent.alias("urgent_share"))
    return unpivoted(m, ["orders", "sales", "ticket", "urgent_share"], "month").select(F.col("name").alias("key"), "month", "value")


MACRO_SQL = f"""
mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*)::DOUBLE AS orders, sum(o_totalprice) AS sales, avg(o_totalprice) AS ticket, avg((o_orderpriority = '1-URGENT')::INT) * 100 AS urgent_share FROM orders GROUP BY 1),
macro AS (SELECT name AS key, month, value FROM ({unpivot_sql("mo", ["orders", "sales", "ticket", "urgent_share"], "month")}))"""
