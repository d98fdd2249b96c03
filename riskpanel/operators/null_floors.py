"""How much information a column without any would show: floors by permutation, and by the shape of a column.

A permuted target is a draw without replacement: how many of the events fall into each cell of a column is
hypergeometric, one cell after another. So a permutation needs a column's bin table, not its rows, and is exactly as
if the rows were permuted and binned again. Shapes are probed by columns that a row's hash makes up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import woe_table
from .optimal_binning import merged, segment_information
from .ranks import ranged

#: Rows up to which a draw is exact.
EXACT = 10**9 - 1


def hypergeometric(rng: np.random.Generator, own: int, others: int, sample: int) -> int:
    """How many of sample rows are from a cell of own rows; beyond EXACT rows by the normal curve of the same mean and variance."""
    if own <= EXACT and others <= EXACT:
        return int(rng.hypergeometric(own, others, sample))
    n = own + others
    mean = sample * (own / n)
    sd = math.sqrt(max(0.0, mean * (others / n) * ((n - sample) / max(n - 1, 1))))
    return int(min(min(own, sample), max(0, sample - others, round(mean + sd * rng.standard_normal()))))


def permuted(rng: np.random.Generator, n: Sequence[int], events: int) -> list[int]:
    """Events by cell when the events are dealt to rows at random."""
    left, rest, out = events, int(sum(n)), []
    for own in map(int, n):
        rest -= own
        out.append(hypergeometric(rng, own, rest, left))
        left -= out[-1]
    return out


def permutation_floor(counts: DataFrame, draws: int = 8, seed: int = 11, most: int = 8, trend: str = "any", rebinned: bool = True, least_share: float = 0.02, least_rows: int = 30) -> DataFrame:
    """By column mean, sd and floor (mean + 2 sd) of the information of permuted targets, and the mean's standard error.

    counts: name, bin, n, events. rebinned: each permutation is binned anew, so that the floor has the binning's own overfitting in it;
    missing values (bin -1) are one more bin. Draws depend on the seed and the column's name only.
    """

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        pdf = pdf.sort_values("bin")
        n, total = pdf["n"].to_numpy(), int(pdf["events"].sum())
        rng, ivs = np.random.default_rng([seed, zlib.crc32(str(name).encode())]), []
        missing = (pdf["bin"] == -1).to_numpy()
        for _ in range(draws):
            e = np.array(permuted(rng, n, total), float)
            starts = merged(n[~missing], e[~missing], most, 1, least_share, least_rows, trend)[0] if rebinned else list(range(int((~missing).sum())))
            sums = [np.add.reduceat(v[~missing], starts) if starts else np.zeros(0) for v in (n.astype(float), e)]
            sums = [np.concatenate([s, v[missing]]) for s, v in zip(sums, (n.astype(float), e), strict=True)]
            with np.errstate(invalid="ignore", divide="ignore"):
                ivs.append(float(np.nansum(segment_information(*sums, total, n.sum() - total)[sums[0] > 0])))
        mean, sd = float(np.mean(ivs)), float(np.std(ivs))
        return pd.DataFrame({"column_name": [name], "mean_iv": [mean], "sd_iv": [sd], "floor": [mean + 2 * sd], "mean_error": [sd / math.sqrt(draws)]})

    return counts.groupBy("name").applyInPandas(own, "column_name string, mean_iv double, sd_iv double, floor double, mean_error double")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in any engine and under any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def zipf_shares(levels: int, power: float = 0.75) -> list[float]:
    """Upper ends of the levels' shares: the k-th level's share falls as a power of k."""
    w = np.arange(1, levels + 1, dtype=float) ** -power
    return [round(float(x), 12) for x in np.cumsum(w / w.sum())[:-1]]


def probe_counts(df: DataFrame, target: str, key: Sequence[str], shares: Sequence[float], draws: int, label: str) -> DataFrame:
    """Rows and events (name, bin, n, events) of draws made-up columns, whose level is that of the row's hash among the shares' ends."""
    rows = df.select(F.col(target).alias("_y"), *key, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    size = 1 << len(shares).bit_length()
    ends = F.array(*[F.lit(float(s)) for s in [*shares, *[2.0] * (size - 1 - len(shares))]])
    rows = rows.select("_y", "_draw", unit(*[F.col(c) for c in key], F.lit(label), F.col("_draw")).alias("_u"), ends.alias("_ends"))
    return ranged(rows, "_u", "_ends", "bin", size).groupBy(F.col("_draw").alias("name"), "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("events"))


def shape_floor(df: DataFrame, target: str, key: Sequence[str], kind: str, levels: int = 10, draws: int = 6, most: int = 12, least_share: float = 0.01) -> DataFrame:
    """Mean and floor (mean + 2 sd) of the information of made-up columns of a kind: kind, levels, mean_iv, floor.

    numeric: a continuous column in levels equal pre-bins, merged to most bins by optimal binning without a trend.
    categorical: levels whose shares fall as a power, so that a wide column has a few large levels and a long tail; levels
    below least_share of the rows, or beyond the most frequent, are one.
    """
    label = f"{kind}{levels}"
    if kind == "numeric":
        counts = probe_counts(df, target, key, [i / levels for i in range(1, levels)], draws, label)

        def own(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin")
            return pd.DataFrame({"name": pdf["name"].iloc[:1], "iv": [merged(pdf["n"], pdf["events"], most, trend="any")[1]]})

        ivs = counts.groupBy("name").applyInPandas(own, "name int, iv double")
    else:
        counts = probe_counts(df, target, key, zipf_shares(levels), draws, label)
        whole, order = Window.partitionBy("name"), Window.partitionBy("name").orderBy(F.desc("n"), "bin")
        sized = counts.withColumns({"_all": F.sum("n").over(whole), "_at": F.row_number().over(order)})
        group = F.when((F.col("n") >= least_share * F.col("_all")) & (F.col("_at") <= most), F.col("bin")).otherwise(-1)
        ivs = woe_table(sized.groupBy("name", group.alias("bin")).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))).groupBy("name").agg(F.sum("iv").alias("iv"))
    return ivs.agg(F.lit(kind).alias("kind"), F.lit(levels).alias("levels"), F.avg("iv").alias("mean_iv"), (F.avg("iv") + 2 * F.stddev_pop("iv")).alias("floor"))
