"""Optimal binning: of all ways to merge neighbouring pre-bins that keep a trend, a least size and a number of bins, the one of most information.

Information is a sum over bins, so dynamic programming over (first pre-bin, last pre-bin) of the last bin finds it
exactly. Pre-bins are exact quantiles counted in Spark; one group of a column's pre-bins (some twenty rows) is solved per
task, so columns are solved side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Trends of the event rate that can be asked for. "auto" takes the better one of ascending and descending, "any" puts no bound.
TRENDS = ("ascending", "descending", "peak", "valley", "auto", "any")


def segment_information(n: np.ndarray, events: np.ndarray, all_events: float, all_others: float) -> np.ndarray:
    """Information of bins of n rows, half an observation added to both cells of one with an empty cell; totals stay uncorrected."""
    others = n - events
    half = np.where((events == 0) | (others == 0), 0.5, 0.0)
    pe, pg = (events + half) / max(all_events, 1.0), (others + half) / max(all_others, 1.0)
    return (pe - pg) * np.log(pe / pg)


def forwards(iv: np.ndarray, rate: np.ndarray, fit: np.ndarray, most: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """best[k, i, j]: most information of k + 1 bins over pre-bins 0 to j, the last of them i to j; and the first pre-bin of the bin before.

    sign: 1 rates must not fall, -1 they must not rise, 0 no bound. A bin that isn't fit has -inf.
    """
    p = len(iv)
    best, before = np.full((most, p, p), -np.inf), np.full((most, p, p), -1)
    best[0, 0] = np.where(fit[0], iv[0], -np.inf)
    for k in range(1, most):
        for i in range(1, p):
            left, rates = best[k - 1, :i, i - 1], rate[:i, i - 1]
            if not np.isfinite(left).any():
                continue
            for j in range(i, p):
                if fit[i, j]:
                    own = np.where(sign * (rate[i, j] - rates) >= 0, left, -np.inf) if sign else left
                    h = int(own.argmax())
                    best[k, i, j], before[k, i, j] = own[h] + iv[i, j], h
    return best, before


def starts_of(before: np.ndarray, k: int, i: int, j: int) -> list[int]:
    """First pre-bins of the k + 1 bins that end at j, the last of which begins at i."""
    out = [i]
    while k:
        i, j, k = int(before[k, i, j]), i - 1, k - 1
        out.append(i)
    return out[::-1]


def merged(n: Sequence[float], events: Sequence[float], most: int = 8, least_bins: int = 1, least_share: float = 0.02, least_rows: int = 30, trend: str = "auto") -> tuple[list[int], float, str]:
    """First pre-bins of the best bins, their information, and the trend they have.

    least_bins: taken as a wish; if no merge has so many bins, the best one of fewer is returned. If no merge of
    several bins is allowed, all pre-bins are one.
    """
    if trend not in TRENDS:
        raise ValueError(trend)
    n, events = np.asarray(n, float), np.asarray(events, float)
    p = len(n)
    if not p:
        return [], 0.0, "any"
    at = np.concatenate([[0.0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(events)])
    rows, own = (a[None, 1:] - a[:-1, None] for a in at)
    fit = (np.arange(p)[:, None] <= np.arange(p)[None, :]) & (rows >= max(least_rows, least_share * n.sum()))
    with np.errstate(invalid="ignore", divide="ignore"):
        iv = np.where(fit, segment_information(rows, own, events.sum(), n.sum() - events.sum()), -np.inf)
        rate = np.where(fit, own / rows, np.nan)
    flip = lambda a: a[::-1, ::-1].T  # noqa: E731  segments of the pre-bins in reverse order
    found: list[tuple[int, float, list[int], str]] = []  # bins, information, starts, trend

    def one_way(name: str, sign: int) -> None:
        best, before = forwards(iv, rate, fit, most, sign)
        for k in range(most):
            i = int(best[k, :, p - 1].argmax())
            if np.isfinite(best[k, i, p - 1]):
                found.append((k + 1, float(best[k, i, p - 1]), starts_of(before, k, i, p - 1), name))

    def two_ways(name: str, sign: int) -> None:
        """A bin that both a run from the left and one from the right end in."""
        up, up_before = forwards(iv, rate, fit, most, sign)
        down, down_before = forwards(flip(iv), flip(rate), flip(fit), most, sign)
        for a in range(most):
            for b in range(most - a):
                with np.errstate(invalid="ignore"):
                    both = up[a] + flip(down[b]) - iv
                both = np.where(np.isfinite(both), both, -np.inf)
                i, j = np.unravel_index(int(both.argmax()), both.shape)
                if np.isfinite(both[i, j]):
                    right = [p - s for s in starts_of(down_before, b, int(p - 1 - j), int(p - 1 - i))[1:]]
                    found.append((a + b + 1, float(both[i, j]), [*starts_of(up_before, a, int(i), int(j)), *right[::-1]], name))

    if trend in ("ascending", "auto"):
        one_way("ascending", 1)
    if trend in ("descending", "auto"):
        one_way("descending", -1)
    if trend == "peak":
        two_ways("peak", 1)
    if trend == "valley":
        two_ways("valley", -1)
    if trend == "any":
        one_way("any", 0)
    enough = [f for f in found if f[0] >= least_bins] or found
    if not enough:
        return [0], float(segment_information(n.sum(keepdims=True), events.sum(keepdims=True), events.sum(), n.sum() - events.sum())[0]), "any"
    bins, value, starts, name = max(enough, key=lambda f: (f[1], -f[0]))
    return starts, value, name


def optimal_bins(counts: DataFrame, edges: DataFrame, most: int = 8, least_bins: int = 1, least_share: float = 0.02, least_rows: int = 30, trend: str = "auto") -> DataFrame:
    """By column the best merge of its pre-bins: column_name, bins, iv, trend, starts (first pre-bins) and edges.

    counts: name, bin, n, events, as bin_counts() gives them; missing values (bin -1) are no part of the order, and neither are pre-bins without rows. edges: name, edges.
    """

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf["bin"] >= 0) & (pdf["n"] > 0)].sort_values("bin")
        places, iv, name = merged(pdf["n"], pdf["events"], most, least_bins, least_share, least_rows, trend)
        starts, cut = [int(pdf["bin"].iloc[p]) for p in places], list(pdf["edges"].iloc[0]) if len(pdf) else []
        return pd.DataFrame({"column_name": [pdf["name"].iloc[0]], "bins": [len(starts)], "iv": [iv], "trend": [name], "starts": [starts], "edges": [[float(cut[s - 1]) for s in starts[1:]]]}) if len(pdf) else pd.DataFrame(columns=["column_name", "bins", "iv", "trend", "starts", "edges"])

    return counts.join(edges, "name").groupBy("name").applyInPandas(own, "column_name string, bins int, iv double, trend string, starts array<int>, edges array<double>")
