"""Specifications and versions: canonical identity, differences, a version table, and ranking of search results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import running_totals

#: Weights of the composite score, and the inflation above which credit falls.
WEIGHTS = {"auc_oot": 0.30, "all_significant": 0.15, "stress_monotone": 0.15, "no_core_shift": 0.10, "vif": 0.20, "oot_gap": 0.10}
VIF_FLAG = 5.0


def canonical(value: object) -> object:
    """Equal meanings give equal values: whole floats are ints, tuples are lists, keys are strings."""
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def identity(spec: dict) -> str:
    """SHA-256 of a specification's canonical JSON."""
    return hashlib.sha256(json.dumps(canonical(spec), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def changes(parent: dict, child: dict) -> list[tuple[str, str]]:
    """(what, name): variables added, removed or treated otherwise, and other fields that differ."""
    a, b = ({v["column"]: v for v in s.get("variables", [])} for s in (parent, child))
    found = [("added", c) for c in b if c not in a] + [("removed", c) for c in a if c not in b]
    found += [("changed", f"{c}.{k}") for c in b if c in a for k in sorted({*a[c], *b[c]}) if canonical(a[c].get(k)) != canonical(b[c].get(k))]
    return found + [("field", k) for k in sorted({*parent, *child} - {"variables"}) if canonical(parent.get(k)) != canonical(child.get(k))]


VERSION = "hash string, parent string, label string, spec string, metrics string, state string, saved timestamp"


class Versions:
    """An append-only table of model versions: the latest row of a hash holds; champions and deletions are rows too."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, spec: dict, metrics: dict, label: str = "", parent: str | None = None) -> str:
        key = identity(spec)
        self._append([(key, parent, label, json.dumps(canonical(spec), sort_keys=True), json.dumps(metrics, sort_keys=True), "")])
        return key

    def _append(self, row: list[tuple]) -> None:
        self.spark.createDataFrame(row, T.StructType(T._parse_datatype_string(VERSION).fields[:-1])).withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").json(self.path)

    def _last(self) -> DataFrame:
        rows = self.spark.read.schema(VERSION).json(self.path)
        return rows.groupBy("hash").agg(F.max_by(F.struct("parent", "label", "spec", "metrics", "state", "saved"), "saved").alias("x")).select("hash", "x.*")

    def table(self) -> DataFrame:
        """The versions that are not deleted; state is champion, archived or empty."""
        return self._last().filter("coalesce(state, '') != 'deleted'")

    def load(self, key: str) -> dict:
        row = self.table().filter(F.col("hash") == key).first()
        if row is None:
            raise KeyError(key)
        return {**row.asDict(), "spec": json.loads(row.spec), "metrics": json.loads(row.metrics)}

    def mark(self, key: str, state: str) -> None:
        """Give a version another state: "", archived or deleted. Champions are made by promote."""
        v = self.load(key)
        self._append([(key, v["parent"], v["label"], json.dumps(v["spec"], sort_keys=True), json.dumps(v["metrics"], sort_keys=True), state)])

    def delete(self, key: str) -> None:
        self.mark(key, "deleted")

    def champion(self) -> str | None:
        row = self.table().filter("state = 'champion'").first()
        return row.hash if row else None

    def promote(self, key: str) -> None:
        """Make a version the champion; the one before is archived."""
        self.load(key)
        before = self.champion()
        if before == key:
            return
        if before:
            self.mark(before, "archived")
        self.mark(key, "champion")

    def compare(self, a: str, b: str) -> DataFrame:
        """By metric of either version: both values and the difference."""
        x, y = self.load(a)["metrics"], self.load(b)["metrics"]
        value = lambda v: None if v is None else float(v)
        rows = [(m, value(x.get(m)), value(y.get(m))) for m in sorted({*x, *y})]
        return self.spark.createDataFrame(rows, "metric string, a double, b double").withColumn("change", F.col("b") - F.col("a"))

    def export(self, key: str) -> str:
        """A version as JSON, which take reads."""
        v = self.load(key)
        return json.dumps({k: v[k] for k in ("hash", "parent", "label", "spec", "metrics")}, sort_keys=True)

    def take(self, text: str, refit: Callable[[dict], dict], tol: float = 1e-9) -> str:
        """Save an exported version, if its hash is that of its specification and a new fit gives its metrics to within tol."""
        v = json.loads(text)
        if v.get("hash") != identity(v["spec"]):
            raise ValueError("the hash is not that of the specification")
        fresh = refit(v["spec"])
        off = sorted(m for m, x in v["metrics"].items() if fresh.get(m) is None or abs(fresh[m] - x) > tol)
        if off:
            raise ValueError(f"a new fit differs in {', '.join(off)}")
        return self.save(v["spec"], v["metrics"], v.get("label") or "", v.get("parent"))

    def lineage(self, key: str, depth: int = 50) -> list[str]:
        """The version and its ancestors; a chain of at most depth."""
        chain, parents = [], {r.hash: r.parent for r in self.table().select("hash", "parent").collect()}
        while key in parents and key not in chain and len(chain) < depth:
            chain.append(key)
            key = parents[key]
        return chain


def enumerate_combos(terms: Sequence[tuple[str, str, int]], most: int = 3, correlation: dict[frozenset, float] | None = None, limit: float = 0.7) -> Iterator[tuple]:
    """Sets of 1 to most terms (key, transform, lag) of different families whose pairs don't correlate above the limit."""
    family = lambda k: k.removesuffix("_yoy").removesuffix("_growth")
    for size in range(1, most + 1):
        for combo in combinations(terms, size):
            names = ["@".join(map(str, t)) for t in combo]
            if len({family(t[0]) for t in combo}) == size and all(abs((correlation or {}).get(frozenset(p), 0.0)) <= limit for p in combinations(names, 2)):
                yield combo


def vif_credit(vif: Column, flag: float = VIF_FLAG) -> Column:
    """Credit for inflation: 1 up to the flag, from there falling by 1 over a width of the flag to 0, then by 1 over twice that width to -1."""
    over = vif / flag - 1
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), over)) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (over - 1) / 2))


def composite_rank(rows: DataFrame, flag: float = VIF_FLAG) -> DataFrame:
    """rows (hash, auc_in, auc_oot, all_significant, stress_monotone, core_shifted, max_vif, filtered) with score and auto_rank; filtered ones get neither."""
    live = rows.filter("NOT filtered").withColumn("_a", F.coalesce("auc_oot", "auc_in"))
    ends = live.agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    gap = F.greatest(F.lit(0.0), F.col("auc_in") - F.col("_a"))
    score = (
        WEIGHTS["auc_oot"] * (F.col("_a") - F.col("_lo")) / span + WEIGHTS["all_significant"] * one(F.col("all_significant")) + WEIGHTS["stress_monotone"] * one(F.col("stress_monotone"))
        + WEIGHTS["no_core_shift"] * one(~F.col("core_shifted")) + WEIGHTS["vif"] * vif_credit(F.coalesce("max_vif", F.lit(1.0)), flag) + WEIGHTS["oot_gap"] * F.greatest(F.lit(0.0), 1 - gap / 0.10)
    )
    scored = live.crossJoin(F.broadcast(ends)).withColumn("score", F.round(score, 10))
    # Places come from totals of different scores, within ranges of them; ties are numbered within their score.
    above = running_totals(scored.groupBy("score").agg(F.count(F.lit(1)).alias("_n")), "score", ["_n"])
    above = above.select("score", (F.col("all__n") - F.col("before__n") - F.col("_n")).alias("_above"))
    tie = F.row_number().over(Window.partitionBy("score").orderBy("hash"))
    ranked = scored.join(above, "score").select("hash", "score", (F.col("_above") + tie).cast("int").alias("auto_rank"))
    return rows.join(ranked, "hash", "left")
