"""Loan tapes: mapping of a seller's columns, gates on the target and dates, ingest as parquet with a registry."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clamp, month_of, months_on_book

REQUIRED = ["account_id", "performance_date", "default_flag"]
OPTIONAL = ["current_balance", "origination_date", "months_on_book", "scheduled_payment", "interest_rate", "remaining_term", "committed_amount", "lgd_realised", "exposure_at_default", "workout_months"]
#: Other spellings that sellers use, in lower case without separators.
ALIASES = {
    "account_id": ["accountid", "loannumber", "loanid", "accountnumber", "id"],
    "performance_date": ["performancedate", "asofdate", "reportingdate", "period", "month"],
    "default_flag": ["defaultflag", "defaultind", "default", "isdefault"],
    "current_balance": ["currentbalance", "upb", "balance", "outstandingbalance"],
    "origination_date": ["originationdate", "origdate", "bookingdate"],
    "interest_rate": ["interestrate", "rate", "notrate", "coupon"],
    "lgd_realised": ["lgdrealised", "lgd", "lossgivendefault"],
    "committed_amount": ["committedamount", "limit", "creditlimit"],
}
MAX_BAD_DATES = 0.02


class TapeError(ValueError):
    """A tape that can't be taken as a panel."""


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, or parquet, by the path's ending."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def suggest_mapping(columns: Sequence[str]) -> dict[str, str]:
    """Source column by canonical name: the same name first, then aliases; case and separators don't count, a column is used once."""
    bare = {re.sub("[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
    found: dict[str, str] = {}
    for rounds in (lambda n: [re.sub("[^a-z0-9]", "", n)], lambda n: ALIASES.get(n, [])):
        for name in [*REQUIRED, *OPTIONAL]:
            hit = next((bare[a] for a in rounds(name) if a in bare and bare[a] not in found.values()), None)
            if name not in found and hit:
                found[name] = hit
    return found


def column_report(df: DataFrame) -> DataFrame:
    """By column: type, distinct values, missing, and whether a text column holds numbers only (of 20 different ones or more)."""
    kinds = dict(df.dtypes)
    parts = []
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`").cast("string")
        parts += [F.count_distinct(text).alias(f"u{i}"), F.count_if(text.isNull()).alias(f"m{i}"), F.count_if(text.isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(f"w{i}") if kinds[c] == "string" else F.lit(1).alias(f"w{i}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.col(f"u{i}").alias("n_unique"), F.col(f"m{i}").alias("missing"), ((F.col(f"u{i}") >= 20) & (F.col(f"w{i}") == 0)).alias("numbers_as_text")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """df with canonical names (mapping: source column by canonical name); a clash with another column is refused."""
    missing = [c for c in mapping.values() if c not in df.columns]
    clash = [n for n, c in mapping.items() if n in df.columns and n != c and n not in mapping.values()]
    if missing or clash:
        raise TapeError(f"unknown columns {missing}, names already taken {clash}")
    return df.withColumnsRenamed({c: n for n, c in mapping.items()})


def gate(df: DataFrame) -> DataFrame:
    """One row of counts that decide about a tape: rows, dates that don't parse, flags that aren't 0 or 1, null flags, repeated keys."""
    date = F.expr("try_cast(performance_date AS timestamp)")
    flag = F.expr("try_cast(default_flag AS double)")
    own = df.select("account_id", date.alias("_d"), flag.alias("_f"), F.col("performance_date").isNotNull().alias("_has"), F.col("default_flag").isNotNull().alias("_flagged"))
    counts = own.groupBy("account_id", month_of(F.col("_d")).alias("_m")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_has") & F.col("_d").isNull()).alias("bad_dates"),
        F.count_if(F.col("_flagged") & (F.col("_f").isNull() | ~F.col("_f").isin(0.0, 1.0))).alias("bad_flags"), F.count_if(~F.col("_flagged")).alias("null_flags"),
    )
    return counts.agg(F.sum("n").alias("n_rows"), F.sum("bad_dates").alias("bad_dates"), F.sum("bad_flags").alias("bad_flags"), F.sum("null_flags").alias("null_flags"), F.sum(F.col("n") - 1).alias("repeated_keys"))


def panel_of(df: DataFrame) -> DataFrame:
    """The typed panel of a mapped tape: month starts, 0/1 flag (null: 0), severity within [0, 1], months on book."""
    out = df.withColumns({"performance_date": month_of(F.expr("try_cast(performance_date AS timestamp)")), "default_flag": F.coalesce(F.expr("try_cast(default_flag AS double)"), F.lit(0.0)).cast("tinyint")})
    if "lgd_realised" in df.columns:
        out = out.withColumn("lgd_realised", clamp(F.expr("try_cast(lgd_realised AS double)"), 0.0, 1.0))
    if "origination_date" in df.columns and "months_on_book" not in df.columns:
        out = out.withColumn("months_on_book", months_on_book(F.col("performance_date"), F.expr("try_cast(origination_date AS timestamp)").cast("date")))
    return out.filter("performance_date IS NOT NULL")


def warnings_for(df: DataFrame) -> list[str]:
    """What a panel lacks for later steps."""
    wants = {"lgd_realised": "no severity: losses need an assumed one", "current_balance": "no balance: exposures are unknown", "remaining_term": "no term: exposure stays flat", "committed_amount": "no limit: undrawn amounts are unknown"}
    return [text for c, text in wants.items() if c not in df.columns]


def checked(key: str) -> str:
    """A book's key, which names a folder."""
    if not re.fullmatch(r"[a-z][a-z0-9_]{1,40}", key):
        raise TapeError(f"not a key: {key!r}")
    return key


def ingest(spark: SparkSession, df: DataFrame, mapping: dict[str, str], root: str, key: str) -> dict:
    """Check, type and write a tape below root; returns and stores its registry record. Refused tapes raise TapeError."""
    checked(key)
    lacking = [c for c in REQUIRED if c not in mapping]
    if lacking:
        raise TapeError(f"required columns without a source: {lacking}")
    own = mapped(df, mapping)
    g = gate(own).first()
    if g.bad_flags or g.repeated_keys or (g.bad_dates or 0) > MAX_BAD_DATES * (g.n_rows or 1):
        raise TapeError(f"{g.bad_flags} flags are not 0 or 1, {g.repeated_keys} keys repeat, {g.bad_dates} dates don't parse")
    panel_of(own).write.mode("overwrite").parquet(f"{root}/{key}/panel")
    record = {"key": key, "mapping": mapping, "n_rows": g.n_rows, "null_flags": g.null_flags, "warnings": warnings_for(own)}
    spark.createDataFrame([(key, json.dumps(record, sort_keys=True))], "key string, record string").coalesce(1).write.mode("overwrite").json(f"{root}/{key}/registry")
    return record


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Records of all ingested books, without reading any panel; malformed ones are left out."""
    rows = spark.read.schema("key string, record string").json(f"{root}/*/registry")
    return rows.filter("key IS NOT NULL AND get_json_object(record, '$.key') = key")


def data_dictionary(df: DataFrame) -> DataFrame:
    """Column, type and null share, as written beside a book."""
    report = column_report(df)
    n = F.lit(df.count())
    return report.select("column_name", "type", "n_unique", F.round(100 * F.col("missing") / n, 4).alias("missing_pct"))


def read_scenario(spark: SparkSession, path: str, headings: dict[str, str]) -> DataFrame:
    """A scenario file (Scenario Name, Date as "2026 Q1", one column per variable) in long form: scenario, key, month, value."""
    raw = spark.read.option("header", True).csv(path)
    quarter = F.regexp_extract("Date", r"(\d{4}) Q(\d)", 2).cast("int")
    month = F.make_date(F.regexp_extract("Date", r"(\d{4}) Q(\d)", 1).cast("int"), quarter * 3 - 2, F.lit(1))
    known = [F.struct(F.lit(k).alias("key"), F.expr(f"try_cast(`{h}` AS double)").alias("value")) for h, k in headings.items() if h in raw.columns]
    return raw.select(F.col("Scenario Name").alias("scenario"), month.alias("month"), F.explode(F.array(*known)).alias("x")).select("scenario", "x.key", "month", "x.value")


def remapped(df: DataFrame, old: dict[str, str], new: dict[str, str]) -> DataFrame:
    """A mapped tape under another mapping: names go back to the seller's, then on to the new ones; required columns can't move."""
    moved = [c for c in REQUIRED if old.get(c) != new.get(c)]
    if moved:
        raise TapeError(f"required columns can't be mapped anew: {moved}")
    return mapped(df.withColumnsRenamed({n: c for n, c in old.items() if n in df.columns}), new)


def remove(spark: SparkSession, root: str, key: str) -> bool:
    """Delete a book's panel and record; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{checked(key)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def peek(spark: SparkSession, path: str, rows: int = 20) -> tuple[DataFrame, int]:
    """The first rows of a tape and its number of rows: of parquet from the footers, of CSV by counting lines, without parsing any column."""
    df = read_tape(spark, path)
    if path.endswith(".csv"):
        return df.limit(rows), max(0, spark.read.text(path).filter("length(value) > 0").count() - 1)
    return df.limit(rows), df.count()
