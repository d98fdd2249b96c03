"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of stored files up to which a table of measured size may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Buckets whose counts one task sums in order.
SHELF = 4096
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: With it, the shuffle files of a query go when it ends. A stored table doesn't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def ship(module_name: str) -> None:
    """Send the functions of a module to the workers by value: no --py-files are needed."""
    for name in (__name__, module_name):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="riskpanel-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Queries that end within it leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs a reread only."""
    path = f"{shared_dir(df.sparkSession)}/riskpanel/{uuid.uuid4().hex}/{name}"
    with without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of a stored table's files."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: it is joined by shuffle and merge at every size, and Spark may split what is skewed."""
    return df.hint("merge")


def within(table: DataFrame, of: DataFrame | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table (or a selection of one), for broadcast if the files, which are measured here, are within the bound; else for a merge join."""
    return F.broadcast(table) if stored_bytes(table if of is None else of) <= bound else grown(table)


def buckets(spark: SparkSession, rows: int, rows_each: int = 4096) -> int:
    """So many buckets that none holds much over rows_each rows, and that all tasks get several."""
    return max(math.ceil(rows / rows_each), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: list[str], order: list[str], to: str, rows: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, though one key may hold most rows.

    Rows are numbered within hash buckets of the order columns, and each bucket starts where the
    buckets before it end. Buckets are summed by shelves of SHELF first, so that no task gets more than a few buckets of
    rows, a shelf of counts, or one count of each shelf; only counts meet by key.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets(df.sparkSession, rows))))
    own, shelf = [*keys, "_bucket"], [*keys, "_shelf"]
    counts = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_shelf", F.floor(F.col("_bucket") / SHELF))
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shelves = counts.groupBy(*shelf).agg(F.sum("_rows").alias("_all")).select(*shelf, F.coalesce(F.sum("_all").over(before(keys, "_shelf")), zero).alias("_base"))
    starts = counts.select(*own, "_shelf", F.coalesce(F.sum("_rows").over(before(shelf, "_bucket")), zero).alias("_in_shelf"))
    starts = starts.join(shelves, shelf).select(*own, (F.col("_base") + F.col("_in_shelf")).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1
    numbered = df.withColumn("_inner", inner)
    return numbered.join(starts, own).withColumn(to, (F.col("_start") + F.col("_inner")).cast("long")).drop("_bucket", "_start", "_inner")


def text_key(text: str) -> list:
    """Two independent 64-bit hashes of a text (null: as if empty), as columns _h1 and _h2."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit(7), whole).alias("_h2")]
