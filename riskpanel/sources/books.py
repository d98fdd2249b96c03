"""Books on disk: panel and accounts bucketed by account, swapped in whole, so that joins and windows by account move no rows.

A book is a folder of versions. A version's two tables are written first, each bucket by one task; only then a manifest
with the next number is renamed into place, which readers take the highest of. A writer that dies leaves nothing that is
read; a reader that opened a version keeps it until it is pruned. Manifests tell how a table is bucketed, so any session can
open it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import account_dimension, static_columns

#: Buckets of a book; a bucket's file should be a task's work.
BUCKETS = 32
KEY = re.compile(r"[a-z][a-z0-9_]{1,40}")
MANIFEST = re.compile(r"manifest-(\d{8})\.json")


class BookError(ValueError):
    """A book that can't be written or read."""


class Store:
    """Books below a root folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, key: str, *more: str) -> str:
        if not KEY.fullmatch(key):
            raise BookError(f"not a key: {key!r}")
        return "/".join([self.root, key, *more])

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []

    def text(self, path: str) -> str:
        return "".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def manifests(self, key: str) -> list[tuple[int, dict]]:
        """All versions of a book, newest first; malformed manifests are left out."""
        out = []
        for name in self.names(self.at(key)):
            if m := MANIFEST.fullmatch(name):
                try:
                    out.append((int(m[1]), json.loads(self.text(self.at(key, name)))))
                except json.JSONDecodeError:
                    continue
        return sorted(out, key=lambda x: -x[0])

    def keys(self) -> list[str]:
        """Books that can be opened, without a look at any panel."""
        return sorted(k for k in self.names(self.root) if KEY.fullmatch(k) and self.manifests(k))

    def write(self, df: DataFrame, key: str, version: str, name: str, sort: Sequence[str], buckets: int) -> dict:
        path, table = self.at(key, version, name), f"book_{key}_{version}_{name}"
        dealt = df.repartition(buckets, sort[0])  # by the hash that buckets have: one file each
        dealt.write.format("parquet").bucketBy(buckets, sort[0]).sortBy(*sort).option("path", path).saveAsTable(table)
        return {"table": table, "path": path, "schema": self.spark.table(table).schema.toDDL(), "sort": list(sort), "buckets": buckets}

    def save(self, key: str, panel: DataFrame, accounts: DataFrame | None = None, buckets: int = BUCKETS, keep: int = 1, **about: object) -> dict:
        """Write a version of a book and swap it in; keep earlier versions stay. Without accounts, the columns that never change within an account are taken out of the panel."""
        self.at(key)
        if accounts is None:
            moving = ["account_id", "performance_date"]
            others = [c for c in panel.columns if c not in moving]
            still = [r.column_name for r in static_columns(panel, others).filter("static").collect()] if others else []
            accounts, panel = account_dimension(panel, still), panel.drop(*still)
        version = uuid.uuid4().hex[:12]
        tables = {"panel": self.write(panel, key, version, "panel", ["account_id", "performance_date"], buckets), "accounts": self.write(accounts, key, version, "accounts", ["account_id"], buckets)}
        before = self.manifests(key)
        record = {"key": key, "version": version, **about, **tables}
        number = max([0, *[int(m[1]) for n in self.names(self.at(key)) if (m := MANIFEST.fullmatch(n))]]) + 1
        self.put(record, self.at(key, f"manifest-{number:08d}.json"))
        for old, own in before[keep:]:
            self.files.delete(self.path(self.at(key, f"manifest-{old:08d}.json")), False)
            self.files.delete(self.path(self.at(key, own["version"])), True)
        return record

    def put(self, record: dict, path: str) -> None:
        """A file that is there whole or not at all; of two writers of one name the second one fails."""
        staged = self.path(f"{path}.{uuid.uuid4().hex}")
        out = self.files.create(staged, False)
        try:
            out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        finally:
            out.close()
        if self.files.exists(self.path(path)) or not self.files.rename(staged, self.path(path)):
            self.files.delete(staged, False)
            raise BookError(f"{path} was written by someone else")

    def table(self, own: dict) -> DataFrame:
        if not self.spark.catalog.tableExists(own["table"]):
            by = ", ".join(f"`{c}`" for c in own["sort"])
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {own['table']} ({own['schema']}) USING parquet CLUSTERED BY (`{own['sort'][0]}`) SORTED BY ({by}) INTO {own['buckets']} BUCKETS LOCATION '{own['path']}'")
        return self.spark.table(own["table"])

    def open(self, key: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Panel and accounts of the newest version, or of a named one."""
        for _, own in self.manifests(key):
            if version in (None, own["version"]):
                return self.table(own["panel"]), self.table(own["accounts"])
        raise BookError(f"no book {key}" + (f" of version {version}" if version else ""))

    def frame(self, key: str, version: str | None = None) -> DataFrame:
        """Panel with its accounts' columns; where both have a column, the panel's is taken."""
        panel, accounts = self.open(key, version)
        own = accounts.select("account_id", *[c for c in accounts.columns if c not in panel.columns])
        return panel.join(own, "account_id", "left")

    def remove(self, key: str) -> bool:
        """Delete a book with all its versions; False if there is none."""
        for _, own in self.manifests(key):
            for name in ("panel", "accounts"):
                self.spark.sql(f"DROP TABLE IF EXISTS {own[name]['table']}")
        return self.files.delete(self.path(self.at(key)), True)

    def archive(self, to: str) -> list[str]:
        """Move all books below another folder; their keys."""
        keys = self.keys()
        self.files.mkdirs(self.path(to))
        for key in keys:
            if not self.files.rename(self.path(self.at(key)), self.path(f"{to.rstrip('/')}/{key}")):
                raise BookError(f"{key} can't be moved to {to}")
        return keys


def sample_rows(df: DataFrame, rows: int = 5000) -> DataFrame:
    """The first rows of a panel in the order of its key, as its sample file has them."""
    return df.orderBy("account_id", "performance_date").limit(rows)


def write_sample(df: DataFrame, path: str, rows: int = 5000) -> None:
    sample_rows(df, rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

