"""Bucketed books: versions, swaps, plans without exchanges."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskpanel.sources import books, tape


@pytest.fixture()
def store(spark, tmp_path):
    return books.Store(spark, str(tmp_path / "books"))


def panel(spark, accounts=60, shift=0):
    rows = spark.range(accounts).select(F.col("id").alias("account_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("m"))
    return rows.select("account_id", F.add_months(F.lit("2001-01-01").cast("date"), F.col("m")).alias("performance_date"), (F.col("account_id") * 10 + F.col("m") + shift).cast("double").alias("current_balance"), F.concat(F.lit("s"), F.col("account_id") % 3).alias("segment"))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_joins_and_windows_by_account_move_no_rows(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.save("demo", panel(spark), buckets=4)
        rows, accounts = store.open("demo")
        assert rows.columns == ["account_id", "performance_date", "current_balance"] and accounts.columns == ["account_id", "segment"]
        frame = store.frame("demo")
        w = Window.partitionBy("account_id").orderBy("performance_date")
        lagged = frame.withColumn("before", F.lag("current_balance").over(w)).groupBy("account_id", "segment").agg(F.sum("before").alias("s"))
        assert exchanges(lagged) == 0
        assert exchanges(panel(spark).repartition(3).withColumn("before", F.lag("current_balance").over(w))) > 0
        assert sorted(map(tuple, frame.select(panel(spark).columns).collect())) == sorted(map(tuple, panel(spark).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_are_swapped_in_whole(spark, store, tmp_path):
    first = store.save("demo", panel(spark), buckets=2, note="one")
    old, _ = store.open("demo")
    second = store.save("demo", panel(spark, 5, 1), buckets=3)
    assert store.open("demo")[0].count() == 50 and store.open("demo", first["version"])[0].count() == 600 and old.count() == 600
    assert store.manifests("demo")[1][1]["note"] == "one"
    third = store.save("demo", panel(spark, 6), buckets=2, keep=1)  # the first one goes
    assert [m["version"] for _, m in store.manifests("demo")] == [third["version"], second["version"]]
    with pytest.raises(books.BookError):
        store.open("demo", first["version"])
    # What a writer that died has left is not read, and neither is a malformed manifest.
    base = tmp_path / "books" / "demo"
    (base / "manifest-00000099.json.abc").write_text("{")
    (base / "manifest-00000050.json").write_text("{not json")
    assert store.open("demo")[0].count() == 60 and store.keys() == ["demo"]
    assert store.save("demo", panel(spark, 2), buckets=2) and store.open("demo")[0].count() == 20
    with pytest.raises(books.BookError):
        store.put({}, str(base / "manifest-00000050.json"))


def test_another_session_opens_a_book(spark, store):
    record = store.save("demo", panel(spark), buckets=4)
    for name in ("panel", "accounts"):
        spark.sql(f"DROP TABLE {record[name]['table']}")
    frame = store.frame("demo")
    assert frame.count() == 600 and [c.name for c in spark.catalog.listColumns(record["panel"]["table"]) if c.isBucket] == ["account_id"]
    assert json.loads(store.text(store.at("demo", "manifest-00000001.json")))["panel"]["buckets"] == 4


def test_given_accounts_and_name_clashes(spark, store):
    accounts = spark.createDataFrame([(i, "x", -1.0) for i in range(30)], "account_id long, segment string, current_balance double")
    store.save("demo", panel(spark), accounts, buckets=2)
    frame = store.frame("demo")
    assert frame.filter("segment = 'x'").count() == 0 and frame.filter("current_balance < 0").count() == 0  # the panel's columns are taken


def test_keys_and_removal(spark, store, tmp_path):
    for key in ("", "..", "A", "x/y", "1a"):
        with pytest.raises(books.BookError):
            store.save(key, panel(spark, 1))
        with pytest.raises(books.BookError):
            store.remove(key)
        with pytest.raises(tape.TapeError):
            tape.remove(spark, str(tmp_path), key)
    store.save("one", panel(spark, 2), buckets=1)
    store.save("two", panel(spark, 3), buckets=1)
    assert store.remove("one") and not store.remove("one") and store.keys() == ["two"]
    assert store.archive(str(tmp_path / "old")) == ["two"] and store.keys() == []
    assert books.Store(spark, str(tmp_path / "old")).keys() == ["two"]
    with pytest.raises(books.BookError):
        store.open("two")


def test_sample_file(spark, tmp_path):
    books.write_sample(panel(spark), str(tmp_path / "sample"), 25)
    back = spark.read.option("header", True).csv(str(tmp_path / "sample"))
    assert back.count() == 25 and back.filter("account_id > 2").count() == 0
