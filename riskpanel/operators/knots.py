"""Where the knots of a piecewise-linear curve belong: greedy choice with refinement on bucket counts.

Rows are counted once, by fine buckets of their values between the 1st and the 99th percentile; the search then works on
some hundred points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp
from .ranks import many_quantiles, ranged

#: Quantiles at which a knot may be placed, how far two knots are apart at least (a share of the range), and what a search needs.
GRID, SEPARATION = [round(0.05 + 0.025 * i, 4) for i in range(37)], 0.04
LEAST_ROWS, LEAST_EVENTS, LEAST_SEVERITIES, LEAST_EDGES = 500, 20, 80, 6


@dataclass
class Found:
    """Knots, those at even quantiles, and how much likelihood the former gain over a line and over the latter; note: why there are none."""

    knots: list[float]
    even: list[float]
    gain_over_line: float = 0.0
    gain_over_even: float = 0.0
    buckets: int = 0
    note: str = ""


def likelihood(x: np.ndarray, n: np.ndarray, events: np.ndarray, knots: Sequence[float]) -> float:
    """Greatest binomial log likelihood (of counts, or of summed shares) of a line that bends at the knots."""
    d = np.column_stack([np.ones_like(x), x, *[np.maximum(x - k, 0) for k in knots]])
    d = d / np.maximum(np.abs(d).max(axis=0), 1e-12)
    b = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
        move = np.linalg.lstsq((d * (n * p * (1 - p))[:, None]).T @ d + 1e-9 * np.eye(len(b)), d.T @ (events - n * p), rcond=None)[0]
        b = b + move
        if np.abs(move).max() < 1e-9:
            break
    eta = np.clip(d @ b, -30, 30)
    return float((events * eta - n * np.logaddexp(0, eta)).sum())


def placed(x: Sequence[float], n: Sequence[float], events: Sequence[float], candidates: Sequence[float], span: float, most: int) -> list[float]:
    """Up to most of the candidates: each is the best beside those before; then each is moved while that helps, twice at most."""
    x, n, events = (np.asarray(v, float) for v in (x, n, events))
    known: dict[tuple, float] = {}

    def value(knots: Sequence[float]) -> float:
        key = tuple(sorted(knots))
        if key not in known:
            known[key] = likelihood(x, n, events, key)
        return known[key]

    def best(others: Sequence[float]) -> float | None:
        free = [c for c in candidates if all(abs(c - o) > SEPARATION * span for o in others)]
        return max(free, key=lambda c: value([*others, c]), default=None)

    chosen: list[float] = []
    while len(chosen) < most and (k := best(chosen)) is not None:
        chosen = sorted([*chosen, k])
    for _ in range(2):
        before = list(chosen)
        for i in range(len(chosen)):
            others = chosen[:i] + chosen[i + 1 :]
            k = best(others)
            if k is not None and value([*others, k]) > value(chosen) + 1e-9:
                chosen[i] = k
        chosen = sorted(chosen)
        if chosen == before:
            break
    return [float(k) for k in chosen]


def search(df: DataFrame, column: str, target: str, most: int = 4, resolution: int = 120, severity: bool = False) -> Found:
    """Knots of a column for an event (0/1), or for a severity within [0, 1] (then a coarser resolution, such as 40, is enough)."""
    y = clamp(F.col(target).cast("double"), 0.0, 1.0)
    rows = df.select(F.col(column).cast("double").alias("v"), y.alias("y")).dropna()
    cells = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("e")).persist()
    try:
        size = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("e"), F.lit(0.0)).alias("e")).first()
        if size.n < (LEAST_SEVERITIES if severity else LEAST_ROWS) or not severity and size.e < LEAST_EVENTS:
            return Found([], [], note="too few events")
        low, high = many_quantiles(cells, "v", "n", [0.01, 0.99])
        if high <= low:
            return Found([], [], note="no range")
        inside = cells.withColumn("v", clamp(F.col("v"), low, high)).groupBy("v").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
        even = [i / (most + 1) for i in range(1, most + 1)]
        q = many_quantiles(inside, "v", "n", [*[i / resolution for i in range(resolution + 1)], *GRID, *even])
        edges = sorted(set(q[: resolution + 1]))
        if len(edges) < LEAST_EDGES:
            return Found([], [], note="too few values")
        width = 1 << (len(edges) - 2).bit_length()
        marks = F.array(*[F.lit(float(e)) for e in [*edges[1:-1], *[float("inf")] * (width - len(edges) + 1)]])
        points = ranged(inside.withColumn("_marks", marks), "v", "_marks", "bucket", width).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).orderBy("bucket").collect()
        x = [(edges[p.bucket] + edges[p.bucket + 1]) / 2 for p in points]
        n, e = [p.n for p in points], [p.e for p in points]
    finally:
        cells.unpersist()
    own = lambda v: [float(k) for k in sorted(set(v)) if low < k < high]
    knots, even = placed(x, n, e, own(q[resolution + 1 : resolution + 1 + len(GRID)]), high - low, most), own(q[resolution + 1 + len(GRID) :])
    fit = lambda ks: likelihood(*(np.asarray(v, float) for v in (x, n, e)), ks)
    return Found(knots, even, fit(knots) - fit([]), fit(knots) - fit(even), len(x))
