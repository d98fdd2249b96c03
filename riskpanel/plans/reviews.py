"""The record of a review of search results: an append-only audit, from which the present state follows."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a model's status may be, and the codes of reasons.
STATUSES = ("champion", "challenger", "rejected")
REASON_CODES = (
    "counterintuitive_mev_sign",
    "mev_not_intuitive_for_portfolio",
    "unstable_coefficients",
    "weak_stress_response",
    "business_judgment",
    "other",
)
FIELDS = ("status", "reason_code", "justification", "user_rank")
AUDIT = "seq long, at timestamp, reviewer string, model string, field string, before string, after string"


class ReviewError(ValueError):
    """A change that the record refuses."""


class Reviews:
    """Changes of models by reviewers: a rejection, or a rank other than the search's, needs a justification."""

    def __init__(self, spark: SparkSession, path: str, statuses: Sequence[str] = STATUSES) -> None:
        self.spark, self.path, self.statuses = spark, path, statuses

    def audit(self) -> DataFrame:
        """All changes, as they were made."""
        if not self._there():
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.schema(AUDIT).json(self.path)

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def state(self) -> DataFrame:
        """One row of each model under review: the last value of each field."""
        g = self.audit().groupBy("model").agg(*[F.max_by(F.when(F.col("field") == f, F.col("after")), F.when(F.col("field") == f, F.col("seq"))).alias(f) for f in FIELDS])
        return g.withColumn("user_rank", F.col("user_rank").cast("int"))

    def update(self, model: str, changes: dict, reviewer: str, auto_rank: int | None = None) -> None:
        """Set fields of one model; what is equal to what it was leaves no trace."""
        self._append([(model, changes, auto_rank)], reviewer)

    def reorder(self, order: Sequence[str], reviewer: str, auto_ranks: dict[str, int], justifications: dict[str, str] | None = None) -> None:
        """Rank all models of a board, best first. Nothing is written if one that leaves its place has no justification, now or on file.

        A model that stays at its automatic rank and never had another gets no row.
        """
        said, now = justifications or {}, self._now(order)
        moves = []
        for rank, model in enumerate(order, 1):
            change = {"user_rank": rank} if rank != auto_ranks.get(model) or now.get(model, {}).get("user_rank") is not None else {}
            if said.get(model, "").strip():
                change["justification"] = said[model]
            moves.append((model, change, auto_ranks.get(model)))
        self._append(moves, reviewer)

    def export_csv(self, path: str) -> None:
        """The audit as CSV with a header, in the order of the changes."""
        self.audit().orderBy("seq").drop("seq").write.mode("overwrite").option("header", True).csv(path)

    def _now(self, models: Sequence[str]) -> dict[str, dict]:
        return {r.model: r.asDict() for r in self.state().filter(F.col("model").isin(list(models))).collect()}  # the models of one board

    def _append(self, moves: Sequence[tuple[str, dict, int | None]], reviewer: str) -> None:
        if not (reviewer or "").strip():
            raise ReviewError("who reviews must be named")
        now, found = self._now([m for m, _, _ in moves]), []
        for model, changes, auto_rank in moves:
            old = {f: now.get(model, {}).get(f) for f in FIELDS}
            new = {**old, **changes}
            if unknown := set(changes) - set(FIELDS):
                raise ReviewError(f"no such fields: {sorted(unknown)}")
            if new["status"] is not None and new["status"] not in self.statuses:
                raise ReviewError(f"a status is one of {', '.join(self.statuses)}")
            if new["reason_code"] is not None and new["reason_code"] not in REASON_CODES:
                raise ReviewError(f"a reason is one of {', '.join(REASON_CODES)}")
            why = (new["justification"] or "").strip()
            if not why and new["status"] == "rejected":
                raise ReviewError(f"{model}: a rejection needs a justification")
            if not why and None not in (new["user_rank"], auto_rank) and new["user_rank"] != auto_rank:
                raise ReviewError(f"{model}: a rank other than the automatic one needs a justification")
            found += [(model, f, old[f], new[f]) for f in FIELDS if f in changes and old[f] != new[f]]
        if found:
            seq = time.time_ns()
            text = lambda v: None if v is None else str(v)
            rows = [(seq + i, reviewer, m, f, text(a), text(b)) for i, (m, f, a, b) in enumerate(found)]
            rows = self.spark.createDataFrame(rows, "seq long, reviewer string, model string, field string, before string, after string")
            rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(self.path)
