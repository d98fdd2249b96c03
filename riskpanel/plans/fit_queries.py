"""Queries of fits whose coefficients can be said in SQL: saturated designs, ridge and lasso of two cells, corrected frames, and records at fixed coefficients."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimate, fit_record, scenarios
from ..sources import panels
from ..sources.panels import BOOK_SQL, book
from . import search
from .queries import query
from .screening_queries import FRAME_SQL, third_of_book

IN_TIME = "performance_date < DATE '2000-01-01' AND vintage <= 1997"


def shown(spark: SparkSession, model: estimate.Model, places: int = 5) -> DataFrame:
    return spark.createDataFrame([(n, round(float(b), places)) for n, b in zip(model.names, model.beta, strict=True)], "term string, beta double")


def saturated_sql(cells: str) -> str:
    """cells: level (its name), n, e, reference (whether it is that). A saturated logistic fit has each level's own log odds."""
    odds = "ln(e / (n - e))"
    return f"WITH {cells}, r AS (SELECT {odds} AS base FROM cells WHERE reference) SELECT CASE WHEN reference THEN '(intercept)' ELSE level END AS term, round(CASE WHEN reference THEN base ELSE {odds} - base END, 5) AS beta FROM cells, r"


@query(saturated_sql(f"{BOOK_SQL}, cells AS (SELECT 'vintage_' || vintage AS level, count(*) AS n, sum(default_flag)::BIGINT AS e, vintage = min(vintage) OVER () AS reference FROM book WHERE {IN_TIME} GROUP BY vintage)"))
def vintage_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Vintage effects; a column of one value in training is dropped, and its name is not among the coefficients."""
    train = book(spark, sf).filter(IN_TIME).withColumn("constant", F.lit(3.0))
    return shown(spark, estimate.fit_logistic(train, "default_flag", {"vintage": "vintage", "constant": "scaled"}))


AGE_CUTS = [6, 18, 36]
AGE_CELLS = f"CASE WHEN months_on_book IS NULL THEN -1 ELSE {' + '.join(f'(months_on_book >= {c})::INT' for c in AGE_CUTS)} END"


def age_dummies() -> list[estimate.Term]:
    return [estimate.Term("months_on_book", "dummies", edges=[float(c) for c in AGE_CUTS])]


@query(saturated_sql(f"{BOOK_SQL}, cells AS (SELECT 'months_on_book=' || {AGE_CELLS} AS level, count(*) AS n, sum(default_flag)::BIGINT AS e, {AGE_CELLS} = 0 AS reference FROM book WHERE {IN_TIME} GROUP BY ALL)"))
def dummy_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A free level for each bin of age, the first bin being the reference."""
    return shown(spark, estimate.fit_logistic(book(spark, sf).filter(IN_TIME), "default_flag", {}, terms=age_dummies()))


@query(f"""WITH {FRAME_SQL}, f AS (SELECT b.months_on_book, b.default_flag FROM frame JOIN book b USING (account_id, performance_date)),
cells AS (SELECT {AGE_CELLS} AS bin, count(*) AS n, sum(default_flag)::BIGINT AS e FROM f GROUP BY 1),
k AS (SELECT (SELECT sum(n - e) FROM cells) / count(*) FILTER (WHERE default_flag = 0) AS kept FROM book), r AS (SELECT ln(e / (n - e)) AS base FROM cells WHERE bin = 0)
SELECT CASE bin WHEN 0 THEN '(intercept)' ELSE 'months_on_book=' || bin END AS term, round(CASE bin WHEN 0 THEN base + ln(kept) ELSE ln(e / (n - e)) - base END, 5) AS beta FROM cells, r, k""")
def corrected_frame_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A fit on an event-preserving frame, whose intercept is corrected to all rows."""
    frame = third_of_book(spark, sf)
    model = estimate.fit_logistic(frame.rows, "default_flag", {}, terms=age_dummies())
    return shown(spark, estimate.prior_correction(model, frame.kept_share))


FLAG_CUT, REGULARIZATION, LASSO_C = 24, 40.0, 0.05
TWO_CELLS = f"{BOOK_SQL}, c AS (SELECT sum((months_on_book < {FLAG_CUT})::INT)::DOUBLE AS n0, sum(default_flag) FILTER (WHERE months_on_book < {FLAG_CUT})::DOUBLE AS e0, sum((months_on_book >= {FLAG_CUT})::INT)::DOUBLE AS n1, sum(default_flag) FILTER (WHERE months_on_book >= {FLAG_CUT})::DOUBLE AS e1 FROM book)"


def flag_term() -> list[estimate.Term]:
    return [estimate.Term("months_on_book", "dummies", edges=[float(FLAG_CUT)])]


@query(f"""WITH RECURSIVE {TWO_CELLS}, l AS (SELECT *, {REGULARIZATION}::DOUBLE * (n0 + n1) / 1000 AS l2 FROM c),
s AS (SELECT 0 AS i, ln((e0 + e1) / (n0 + n1 - e0 - e1)) AS a, 0::DOUBLE AS b FROM l
  UNION ALL SELECT i + 1, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) FROM (
    SELECT i, a, b, e0 + e1 - n0 * p - n1 * q AS g0, e1 - n1 * q - l2 * b AS g1, n0 * p * (1 - p) + n1 * q * (1 - q) AS h00, n1 * q * (1 - q) AS h01, n1 * q * (1 - q) + l2 AS h11
    FROM (SELECT *, 1 / (1 + exp(-a)) AS p, 1 / (1 + exp(-a - b)) AS q FROM s, l WHERE i < 40)))
SELECT '(intercept)' AS term, round(a, 5) AS beta FROM s WHERE i = 40 UNION ALL SELECT 'months_on_book_flag', round(b, 5) FROM s WHERE i = 40""")
def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A flag with a ridge that grows with the rows."""
    df = book(spark, sf)
    return shown(spark, estimate.fit_logistic(df, "default_flag", {}, l2=estimate.ridge(REGULARIZATION, df.count()), terms=flag_term()))


@query(f"""WITH {TWO_CELLS}, s AS (SELECT *, sign(ln(e1 / (n1 - e1)) - ln(e0 / (n0 - e0))) / {LASSO_C}::DOUBLE AS d FROM c), o AS (SELECT ln(((e0 + d) / n0) / (1 - (e0 + d) / n0)) AS a, ln(((e1 - d) / n1) / (1 - (e1 - d) / n1)) AS t, d FROM s)
SELECT '(intercept)' AS term, round(CASE WHEN (t - a) * d > 0 THEN a ELSE ln((e0 + e1) / (n0 + n1 - e0 - e1)) END, 2) AS beta FROM o, c UNION ALL SELECT 'months_on_book_flag', round(CASE WHEN (t - a) * d > 0 THEN t - a ELSE 0 END, 2) FROM o""")
def lasso_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A flag with an L1 penalty, which moves 1 / C events between the two cells."""
    found = estimate.fit_l1(book(spark, sf), "default_flag", flag_term(), LASSO_C)
    return spark.createDataFrame([(n, round(float(b), 2)) for n, b in found.items()], "term string, beta double")


RECORD_TERMS = [("months_on_book", 30.0, 20.0, 0.3), ("current_balance", 200_000.0, 100_000.0, 0.1), ("committed_amount", 300_000.0, 100_000.0, -0.2)]
_R = {(i, j): f"corr(x{i}, x{j})" for i in (1, 2, 3) for j in (1, 2, 3)}
_DET = "(1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23)"


@query(f"""WITH {BOOK_SQL}, x AS (SELECT {", ".join(f"({c} - {m}::DOUBLE) / {s}::DOUBLE AS x{i + 1}" for i, (c, m, s, _) in enumerate(RECORD_TERMS))} FROM book WHERE {IN_TIME}),
r AS (SELECT corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23, {", ".join(f"{b * b}::DOUBLE * var_pop(x{i + 1}) AS c{i + 1}" for i, (*_, b) in enumerate(RECORD_TERMS))} FROM x),
o AS (SELECT '(intercept)' AS name, 1::DOUBLE AS vif, 0::DOUBLE AS contribution FROM r
  UNION ALL SELECT 'months_on_book', (1 - r23 * r23) / {_DET}, c1 / (c1 + c2 + c3) FROM r UNION ALL SELECT 'current_balance', (1 - r13 * r13) / {_DET}, c2 / (c1 + c2 + c3) FROM r
  UNION ALL SELECT 'committed_amount', (1 - r12 * r12) / {_DET}, c3 / (c1 + c2 + c3) FROM r)
SELECT name, round(vif, 5) AS vif, round(contribution, 7) AS contribution, false AS aliased FROM o""")
def coefficient_record(spark: SparkSession, sf: str) -> DataFrame:
    """Inflation and contributions of three terms at fixed coefficients."""
    terms = [estimate.Term(c, "scaled", mean=m, sd=s) for c, m, s, _ in RECORD_TERMS]
    model = estimate.Model(["(intercept)", *[c for c, *_ in RECORD_TERMS]], [-4.5, *[b for *_, b in RECORD_TERMS]], [0.1] * 4, 0.0, 0, terms)
    return fit_record.recorded(book(spark, sf).filter(IN_TIME), "default_flag", model).table(spark).select("name", F.round("vif", 5).alias("vif"), F.round("contribution", 7).alias("contribution"), "aliased")


@query(f"""WITH {BOOK_SQL}, x AS (SELECT months_on_book AS a, current_balance AS b, 2 * months_on_book + 5 AS d FROM book WHERE {IN_TIME}), r AS (SELECT corr(a, b) AS r FROM x)
SELECT '(intercept)' AS name, 1::DOUBLE AS vif, false AS aliased UNION ALL SELECT 'months_on_book', NULL, true UNION ALL SELECT 'current_balance', round(1 / (1 - r * r), 5), false FROM r UNION ALL SELECT 'doubled', NULL, true""")
def aliased_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A column that another one says again is named with it; the others keep their inflation."""
    df = book(spark, sf).filter(IN_TIME).withColumn("doubled", 2 * F.col("months_on_book") + 5)
    terms = [estimate.Term("months_on_book", "scaled", sd=10.0), estimate.Term("current_balance", "scaled", sd=100_000.0), estimate.Term("doubled", "scaled", sd=10.0)]
    model = estimate.Model(["(intercept)", "months_on_book", "current_balance", "doubled"], [-4.0, 0.1, 0.1, 0.1], [0.1] * 4, 0.0, 0, terms)
    return fit_record.recorded(df, "default_flag", model).table(spark).select("name", F.round("vif", 5).alias("vif"), "aliased")


@query()
def joint_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two cores with all allowed combinations of macro terms, fitted before a boundary and measured before and after it."""
    terms = [("ticket", "yoy", 3), ("orders", "yoy", 0)]
    rows = scenarios.with_terms(book(spark, sf), panels.macro(spark, sf), terms)
    names = ["ticket@yoy@3", "orders@yoy@0"]
    combos = [c for k in (1, 2) for c in combinations(names, k)]
    cores = {"age": ["months_on_book", "segment"], "size": ["months_on_book", "current_balance"]}
    return search.joint_rows(rows, "default_flag", "2000-01-01", cores, {"months_on_book": "hinges", "segment": "woe_levels", "current_balance": "scaled"}, combos, {"ticket@yoy@3": -1, "orders@yoy@0": None})
