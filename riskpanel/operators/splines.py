"""Piecewise-linear splines as uncorrelated columns of unit variance: fitted on training rows, applied as one linear map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import counted_mean

#: Share of a column's variance that must be left beside those before it.
LEFT = 1e-8


def raw(v: Column, knots: Sequence[float]) -> list[Column]:
    """The value, and what it exceeds each knot by."""
    return [v, *[F.greatest(v - F.lit(float(k)), F.lit(0.0)) for k in knots]]


def fitted(df: DataFrame, v: Column, knots: Sequence[float], weight: str | None = None) -> tuple[list[float], list[float], list[list[float]]]:
    """Knots that earn a column, the centers of the raw columns, and the map from centered raw columns to the basis.

    A knot needs rows on both sides, and its column some variance that the ones before don't hold. Two
    aggregates: the ends of the values, and the covariances of the raw columns; only these reach the driver. weight: a column of
    counts, of the rows that a row stands for; then means are taken apart, in aggregates of their own.
    """
    if weight:
        mean = df.agg(counted_mean(v, F.col(weight)).alias("m")).first().m or 0.0
        sd = F.sqrt(counted_mean((v - F.lit(mean)) * (v - F.lit(mean)), F.col(weight)))
    else:
        sd = F.stddev_pop(v)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), sd.alias("sd")).first()
    if not ends.sd or ends.lo == ends.hi:
        return [], [0.0], [[0.0]]
    live = [float(k) for k in sorted(set(knots)) if ends.lo < k < ends.hi]
    cells = raw(v, live)
    n = len(cells)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    if weight:
        w = F.col(weight)
        m = df.agg(*[counted_mean(c, w).alias(f"m{i}") for i, c in enumerate(cells)]).first()
        off = [(c - F.lit(m[f"m{i}"])) / ends.sd for i, c in enumerate(cells)]
        s = m.asDict() | df.agg(*[counted_mean(off[i] * off[j], w).alias(f"c{i}_{j}") for i, j in pairs]).first().asDict()
    else:
        s = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)], *[F.covar_pop(cells[i] / ends.sd, cells[j] / ends.sd).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((n, n))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = s[f"c{i}_{j}"]
    basis, kept = [], []
    for i in range(n):
        w = np.eye(n)[i]
        for b in (*basis, *basis):  # twice, against rounding
            w = w - (b @ cov @ w) * b
        left = w @ cov @ w
        if left > LEFT * cov[i, i]:
            basis.append(w / np.sqrt(left))
            kept.append(i)
    matrix = np.array(basis).T[kept] / ends.sd
    return [live[i - 1] for i in kept if i], [float(s[f"m{i}"]) for i in kept], matrix.tolist()


def columns(v: Column, knots: Sequence[float], center: Sequence[float], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """The basis of a value, by a fitted map."""
    cells = [c - F.lit(float(m)) for c, m in zip(raw(v, knots), center, strict=True)]
    return [sum((c * float(row[i]) for c, row in zip(cells, matrix, strict=True) if row[i]), F.lit(0.0)) for i in range(len(matrix[0]))]
