"""The macro panel by a catalogue: each series' frequency, measure and aggregation are rows of a table, and its rule a value of the row.

One aggregate takes all daily, weekly and monthly series to months, whatever their rules. Quarterly series are
benchmarked, with another series of the panel as indicator where the catalogue names one. Growth is derived last, from levels.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import month_of, period_of
from . import benchmarking
from .macro import trailing_growth

#: What a catalogue's rows may hold.
NATIVE, KIND, MEASURE, AGG = ("D", "W", "M", "Q"), ("stock", "flow"), ("level", "rate", "index", "growth"), ("avg", "eop", "sum", "max")


@dataclass(frozen=True)
class Entry:
    """A macro series. derive: growth is taken of its level (key_level is the level). rebase: scenario paths are scaled to meet its history."""

    key: str
    label: str
    native: str
    kind: str
    measure: str
    agg: str
    unit: str = ""
    area: str = "domestic"
    derive: bool = False
    indicator: str | None = None
    rebase: bool = False

    def __post_init__(self) -> None:
        for value, known in ((self.native, NATIVE), (self.kind, KIND), (self.measure, MEASURE), (self.agg, AGG)):
            if value not in known:
                raise ValueError(f"{self.key}: {value!r} is none of {known}")
        if self.native == "Q" and self.agg == "max":
            raise ValueError(f"{self.key}: a quarterly maximum can't be put on months")


def table_of(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    if len({e.key for e in entries}) < len(entries):
        raise ValueError("a key is in the catalogue twice")
    kinds = {"str": "string", "bool": "boolean", "str | None": "string"}
    return spark.createDataFrame([astuple(e) for e in entries], ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in fields(Entry)))


def resolved(catalogue: DataFrame, history: DataFrame) -> DataFrame:
    """The catalogue with what the history (key, date, value) has of each series: n, first, last, and status ("ok" or "missing")."""
    found = history.filter("value IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    # Series are as few as the catalogue's rows.
    return catalogue.join(found, "key", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "status": F.when(F.col("n") > 0, "ok").otherwise("missing")})


def to_months(history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """key, month and value of all series that aren't quarterly, each by its own rule, in one aggregate."""
    rules = F.broadcast(catalogue.filter("native != 'Q'").select("key", "agg"))
    rows = history.filter("value IS NOT NULL").join(rules, "key")
    by = rows.groupBy("key", month_of(F.col("date")).alias("month")).agg(F.max("agg").alias("agg"), F.avg("value").alias("avg"), F.sum("value").alias("sum"), F.max("value").alias("max"), F.max_by("value", "date").alias("eop"))
    chosen = F.coalesce(*[F.when(F.col("agg") == a, F.col(a).cast("double")) for a in AGG])
    return by.select("key", "month", chosen.alias("value"))


def levels(history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """key, month and value of every series of the catalogue that the history has."""
    monthly = to_months(history, catalogue)
    quarterly = history.filter("value IS NOT NULL").join(F.broadcast(catalogue.filter("native = 'Q'").select("key", "agg", "indicator")), "key")
    quarterly = quarterly.groupBy("key", period_of(F.col("date"), "QS").alias("period")).agg(F.max_by("value", "date").cast("double").alias("value"), F.max("agg").alias("agg"), F.max("indicator").alias("indicator"))
    named = quarterly.select("key", "indicator").distinct()
    helper = monthly.withColumnRenamed("key", "indicator").join(named, "indicator").select("key", "month", "value")
    # End-of-period series need no solving.
    ends = benchmarking.end_of_quarter(quarterly.filter("agg = 'eop'"), helper)
    solved = benchmarking.benchmarked(quarterly.filter("agg != 'eop'"), helper)
    return monthly.unionByName(ends).unionByName(solved)


def panel(history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """key, month and value: levels as they are; of derived growth the level as key_level, and under the key its growth over three months in percent a year."""
    rows = levels(history, catalogue).join(F.broadcast(catalogue.select("key", "derive")), "key")
    grown = trailing_growth(rows.filter("derive").drop("derive")).filter("value IS NOT NULL")
    return rows.select(F.when(F.col("derive"), F.concat("key", F.lit("_level"))).otherwise(F.col("key")).alias("key"), "month", "value").unionByName(grown)
