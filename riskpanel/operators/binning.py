"""Binning and screening: bin tables, weight of evidence, information value, stability, correlation and inflation.

All columns of a screen are unpivoted and binned in one pass. Edges are exact quantiles; they and the bins are small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, period_of
from ..sources.panels import unpivoted
from .ranks import quantiles, running_totals

#: Bands of information value, and what looks like leakage.
IV_BANDS = [(0.02, "not predictive"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong")]
LEAKAGE_LIFT, LEAKAGE_IV, REVIEW_IV = 25.0, 0.75, 0.5
LEAST_PSI_ROWS = 50
#: Values of a column whose ranks are broadcast at most: some 5 MB.
BROADCAST_VALUES = 100_000


def tally(target: str, weight: str | None = None) -> tuple[Column, Column]:
    """Rows and the target's sum. weight: a column of counts, of the rows that a row stands for."""
    return (F.sum(weight), F.sum(F.col(target) * F.col(weight))) if weight else (F.count(F.lit(1)), F.sum(target))


def value_cells(long: DataFrame, target: str, *keys: str, weight: str | None = None) -> DataFrame:
    """Rows and events (n, e) by name, value and keys: one scan and one shuffle, kept, as edges, bins and profiles are sums over it. weight: as tally has it."""
    n, e = tally(target, weight)
    return long.groupBy("name", "value", *keys).agg(n.alias("n"), e.cast("long").alias("e")).persist()


def quantile_edges(long: DataFrame, bins: int, weight: str | None = None) -> DataFrame:
    """long (name, value) to one row by name: edges, the different inner quantiles."""
    q = quantiles(long, "value", [i / bins for i in range(1, bins)], ["name"], weight=weight)
    return q.select("name", F.array_distinct("q").alias("edges"))


def bin_counts(long: DataFrame, edges: DataFrame, target: str, weight: str | None = None) -> DataFrame:
    """By name and bin (-1: missing) count and events; bins without rows are kept, with 0. weight: a column of counts, of which target has the sums."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    binned = long.join(F.broadcast(edges), "name").groupBy("name", bin_index(F.col("value"), F.col("edges")).alias("bin")).agg(rows.alias("n"), F.sum(target).alias("events"))
    every = edges.select("name", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    zero = F.lit(0).cast("long")
    return binned.join(every, ["name", "bin"], "full_outer").select("name", "bin", F.coalesce("n", zero).alias("n"), F.coalesce("events", zero).cast("long").alias("events"))


def level_counts(long: DataFrame, target: str, max_levels: int = 12, min_share: float = 0.01, weight: str | None = None) -> DataFrame:
    """By name and level count and events, and the name's levels before grouping: levels below the share or beyond the most frequent are one, "Other"; null is "Missing". weight: as tally has it."""
    n, e = tally(target, weight)
    each = long.groupBy("name", "value").agg(n.alias("n"), e.alias("events"))
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(Window.partitionBy("name"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    label = F.when(F.col("value").isNull(), "Missing").when((F.col("n") >= min_share * F.col("_all")) & (F.col("_at") <= max_levels), F.col("value")).otherwise("Other")
    raw = F.count("value").over(Window.partitionBy("name"))
    return each.withColumns({"_all": present, "_at": place, "_raw": raw}).groupBy("name", label.alias("bin")).agg(F.sum("n").alias("n"), F.sum("events").cast("long").alias("events"), F.max("_raw").alias("levels"))


def auto_shrinkage(levels: Column, events: Column) -> Column:
    """Pseudo-count: 0 below 15 levels (before any are grouped), else the mean events of a level, 5 at least."""
    return F.when(levels < 15, F.lit(0.0)).otherwise(F.greatest(events / levels, F.lit(5.0)))


def woe_table(counts: DataFrame, shrinkage: Column | float = 0.0) -> DataFrame:
    """counts with rate, share, woe and iv: half an observation is added to both cells of a bin with an empty one; totals stay uncorrected."""
    own = Window.partitionBy("name")
    e, g = F.col("events").cast("double"), (F.col("n") - F.col("events")).cast("double")
    half = F.when((e == 0) | (g == 0), 0.5).otherwise(0.0)
    table = counts.withColumns({"_e": F.sum(e).over(own), "_g": F.sum(g).over(own), "_n": F.sum("n").over(own)})
    pe, pg = (e + half) / F.greatest(F.col("_e"), F.lit(1.0)), (g + half) / F.greatest(F.col("_g"), F.lit(1.0))
    k = F.lit(shrinkage) if not isinstance(shrinkage, Column) else shrinkage
    woe = F.log(pe / pg) * F.when(k > 0, e / (e + k)).otherwise(1.0)
    return table.select("name", "bin", "n", "events", (e / F.nullif("n", F.lit(0))).alias("rate"), (F.col("n") / F.col("_n")).alias("share"), woe.alias("woe"), ((pe - pg) * woe).alias("iv"), F.when(F.col("n") > 0, (e / F.col("_e")) / (F.col("n") / F.col("_n"))).alias("lift"))


def iv_band(iv: Column) -> Column:
    return F.coalesce(*[F.when(iv < hi, name) for hi, name in IV_BANDS], F.lit("suspicious"))


def screen(woe: DataFrame) -> DataFrame:
    """woe_table rows to one row by name: iv, band, greatest lift and its bin, leakage verdict."""
    out = woe.groupBy("name").agg(F.sum("iv").alias("iv"), F.max("lift").alias("lift"), F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"), F.sum("events").alias("events"))
    verdict = F.when((F.col("lift") >= LEAKAGE_LIFT) & (F.col("iv") >= LEAKAGE_IV), "likely").when(F.col("iv") >= REVIEW_IV, "review").otherwise("none")
    return out.select(F.col("name").alias("column_name"), F.round("iv", 8).alias("iv"), iv_band(F.round("iv", 8)).alias("band"), F.round("lift", 6).alias("max_lift"), verdict.alias("leakage"), "bins", "n", "events")


def numeric_screen(df: DataFrame, columns: Sequence[str], target: str, bins: int = 8) -> DataFrame:
    cells = value_cells(unpivoted(df, list(columns), target), target)
    return woe_table(bin_counts(cells, quantile_edges(cells, bins, "n"), "e", "n"))


def categorical_screen(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    counts = level_counts(unpivoted(df, list(columns), target), target)
    sized = counts.withColumn("_v", F.sum("events").over(Window.partitionBy("name")))
    return woe_table(sized, auto_shrinkage(F.col("levels"), F.col("_v")))


def observed_sign(woe: DataFrame) -> DataFrame:
    """By name 1 if the last bin's rate is above the first one's, else -1; null with fewer than 3 bins that have rows."""
    real = woe.filter("bin >= 0 AND n > 0").groupBy("name").agg(F.min_by("rate", "bin").alias("a"), F.max_by("rate", "bin").alias("b"), F.count(F.lit(1)).alias("c"))
    return real.select(F.col("name").alias("column_name"), F.when(F.col("c") >= 3, F.when(F.col("b") > F.col("a"), 1).otherwise(-1)).alias("sign"))


def monotonicity(woe: DataFrame) -> DataFrame:
    """By name "increasing", "decreasing" or "none" of the rates of bins with rows."""
    step = F.col("rate") - F.lag("rate").over(Window.partitionBy("name").orderBy("bin"))
    out = woe.filter("bin >= 0 AND n > 0").withColumn("_step", step).groupBy("name").agg(F.bool_and(F.col("_step") >= 0).alias("up"), F.bool_and(F.col("_step") <= 0).alias("down"))
    return out.select(F.col("name").alias("column_name"), F.when(F.col("up"), "increasing").when(F.col("down"), "decreasing").otherwise("none").alias("trend"))


def merged_edges(edges: Sequence[float], n: Sequence[int], events: Sequence[int], max_bins: int = 8, monotone: bool = True, least_share: float = 0.02, least_rows: int = 30) -> list[float]:
    """Edges after merging neighbouring bins until all have enough rows, are few enough and, if wanted, have rates in one direction.

    Works on a bin table, which is small; merging is additive, so rows are not scanned again.
    """
    edges, n, events = list(edges), list(map(float, n)), list(map(float, events))
    floor = max(least_rows, least_share * sum(n))

    def merge(i: int) -> None:
        n[i : i + 2], events[i : i + 2] = [n[i] + n[i + 1]], [events[i] + events[i + 1]]
        del edges[i]

    while len(n) > 1 and min(n) < floor:
        i = int(np.argmin(n))
        merge(i - 1 if i == len(n) - 1 or (i and n[i - 1] < n[i + 1]) else i)
    rate = lambda i: events[i] / max(n[i], 1)
    while len(n) > 2:
        steps = np.diff([rate(i) for i in range(len(n))])
        sign = 1 if rate(len(n) - 1) >= rate(0) else -1
        wrong = [i for i, s in enumerate(steps) if s * sign < 0] if monotone else []
        if wrong:
            merge(max(wrong, key=lambda i: -steps[i] * sign))
        elif len(n) > max_bins:
            merge(int(np.argmin(np.abs(steps))))
        else:
            break
    return edges


def optimal_edges(df: DataFrame, column: str, target: str, max_bins: int = 8, pre_bins: int = 20, monotone: bool = True) -> list[float]:
    """Edges of a monotone binning: exact quantile pre-bins in Spark, then merging on their counts."""
    long = unpivoted(df, [column], target)
    edges = quantile_edges(long, pre_bins)
    cells = bin_counts(long, edges, target).filter("bin >= 0").orderBy("bin").collect()  # pre_bins rows at most
    first = edges.first()
    return merged_edges(first["edges"], [r.n for r in cells], [r.events for r in cells], max_bins, monotone) if first else []


def null_floor(counts: DataFrame, draws: int = 8, seed: int = 11) -> DataFrame:
    """By name the mean and mean + 2 sd of the information value of a target that is independent of the column.

    Events are drawn again by bin, from the whole's rate with the binomial's normal approximation; no rows are needed.
    """
    own = Window.partitionBy("name")
    rate = F.sum("events").over(own) / F.sum("n").over(own)
    table = counts.withColumn("_p", rate)
    draw = table.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    # A pair of hashes gives a standard normal by the Box-Muller transform, alike whatever the partitioning.
    unit = lambda k: (F.pmod(F.xxhash64("name", F.col("bin").cast("string"), "draw", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / float(1 << 52)
    z = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))
    events = F.least(F.col("n"), F.greatest(F.lit(0), F.round(F.col("n") * F.col("_p") + z * F.sqrt(F.col("n") * F.col("_p") * (1 - F.col("_p"))))))
    drawn = draw.select(F.concat_ws("|", "draw", "name").alias("name"), "bin", "n", events.cast("long").alias("events"))
    ivs = woe_table(drawn).groupBy("name").agg(F.sum("iv").alias("iv")).select(F.substring_index("name", "|", -1).alias("column_name"), "iv")
    return ivs.groupBy("column_name").agg(F.round(F.avg("iv"), 8).alias("mean_iv"), F.round(F.avg("iv") + 2 * F.stddev_pop("iv"), 8).alias("floor"))


def psi_table(long: DataFrame, base: Column, period: Column, bins: int = 10, least: int = LEAST_PSI_ROWS) -> DataFrame:
    """Population stability of each name and period against its base rows: psi and n. Empty cells count as half an observation."""
    # Only base rows are counted by value, for the edges; all others are binned where they are, so their bins' counts alone are shuffled.
    rows = long.filter("value IS NOT NULL").select("name", "value", base.alias("_base"), period.alias("period"))
    baseline = rows.filter("_base").groupBy("name", "value").agg(F.count(F.lit(1)).alias("_w")).persist()
    q = quantiles(baseline, "value", [i / bins for i in range(bins + 1)], ["name"], weight="_w")
    inner = F.array_distinct("q")
    edges = q.select("name", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))).alias("edges"), F.size(inner).alias("_m"))
    binned = rows.join(F.broadcast(edges), "name").withColumn("bin", bin_index(F.col("value"), F.col("edges")))
    binned = binned.groupBy("name", "period", "bin", "_m", "_base").agg(F.count(F.lit(1)).alias("c")).persist()
    cells = binned.groupBy("name", "period", "bin", "_m").agg(F.sum("c").alias("c"))
    base_cells = binned.filter("_base").groupBy("name", "bin").agg(F.sum("c").alias("b"))
    periods = cells.groupBy("name", "period", "_m").agg(F.sum("c").alias("n"))
    total = base_cells.groupBy("name").agg(F.sum("b").alias("bn"))
    every = edges.select("name", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin")).join(base_cells, ["name", "bin"], "left").join(total, "name")
    grid = periods.join(F.broadcast(every), "name").join(cells.drop("_m"), ["name", "period", "bin"], "left")
    share = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 0.5 / F.col(n)).otherwise(F.col(c) / F.col(n))
    a, e = share("c", "n"), share("b", "bn")
    out = grid.groupBy("name", "period", "n", "bn", "_m").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    value = F.when((F.col("n") < LEAST_PSI_ROWS) | (F.col("bn") < LEAST_PSI_ROWS), F.lit(None)).when(F.col("_m") < 3, F.lit(0.0)).otherwise(F.round("psi", 8))
    return out.filter(F.col("n") >= least).select(F.col("name").alias("column_name"), "period", "n", value.cast("double").alias("psi"))


def psi_over_time(df: DataFrame, columns: Sequence[str], baseline_months: int = 12, freq: str = "QS", least: int = LEAST_PSI_ROWS) -> DataFrame:
    """Stability by period against the first months. The columns are kept, as they are read for the start, the edges and the bins."""
    own = df.select("performance_date", *[F.col(c).cast("double").alias(c) for c in columns]).persist()
    start = own.agg(F.add_months(F.min("performance_date"), baseline_months)).first()[0]
    long = unpivoted(own, list(columns), "performance_date")
    return psi_table(long, F.col("performance_date") < F.lit(start), period_of(F.col("performance_date"), freq), least=least)


def bivariate(df: DataFrame, column: str, target: str, edges: Sequence[float], freq: str = "QS", least: int = 250) -> DataFrame:
    """Event rate by bin and period; cells of fewer rows are left out."""
    out = df.groupBy(period_of(F.col("performance_date"), freq).alias("period"), bin_index(F.col(column), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("events"))
    return out.filter(F.col("n") >= least).withColumn("rate", F.round(F.col("events") / F.col("n"), 8))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs a < b in one aggregate, of the rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in list(columns)[i + 1 :]]
    # A null in either column must drop the row from the pair only.
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    return unpivoted(one, [f"{a}|{b}" for a, b in pairs]).select(F.substring_index("name", "|", 1).alias("a"), F.substring_index("name", "|", -1).alias("b"), F.round("value", 8).alias("r")) if pairs else one


def linkage(matrix: np.ndarray) -> list[tuple[int, int, float, int]]:
    """The tree of average linkage at distance 1 - |r|: merges (a, b, distance, columns) from the nearest on; merge i makes cluster n + i.

    Of equally near pairs the first in order of the clusters' least columns is merged.
    """
    n = len(matrix)
    groups = {i: [i] for i in range(n)}
    distance = {(i, j): 1 - abs(float(matrix[i, j])) for i in range(n) for j in range(i + 1, n)}
    out = []
    while len(groups) > 1:
        a, b = min(distance, key=lambda p: (distance[p], groups[p[0]][0], groups[p[1]][0]))
        new, size = n + len(out), len(groups[a]) + len(groups[b])
        out.append((a, b, distance[a, b], size))
        for k in groups:
            if k not in (a, b):  # the mean over all pairs, from those of the two parts
                to = lambda x, k=k: distance[min(x, k), max(x, k)]
                distance[k, new] = (len(groups[a]) * to(a) + len(groups[b]) * to(b)) / size
        distance = {p: d for p, d in distance.items() if a not in p and b not in p}
        groups[new] = sorted(groups.pop(a) + groups.pop(b))
    return out


def leaf_order(tree: Sequence[tuple[int, int, float, int]], n: int) -> list[int]:
    """Columns from left to right in the tree's drawing: the part of lower number stands left, so that related columns are side by side."""
    made = {n + i: sorted((a, b)) for i, (a, b, *_) in enumerate(tree)}
    out, stack = [], [n + len(tree) - 1] if tree else list(range(n))[::-1]
    while stack:
        node = stack.pop()
        if node in made:
            stack += made[node][::-1]
        else:
            out.append(node)
    return out


def clusters(matrix: np.ndarray, threshold: float = 0.7) -> list[int]:
    """Average-linkage clusters of columns whose distance is 1 - |r|: the tree, cut at 1 - threshold."""
    n = len(matrix)
    held = {i: [i] for i in range(n)}
    for i, (a, b, d, _) in enumerate(linkage(matrix)):
        if d > 1 - threshold:
            break
        held[n + i] = held.pop(a) + held.pop(b)
    label = {c: k for k, g in enumerate(sorted(held.values(), key=min)) for c in g}
    return [label[i] for i in range(n)]


def rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman's correlation of all pairs a < b, each over the rows where both are present.

    Equal rows are one with their number, and get the ranks of all their columns: a column's ranks are shared by all pairs, but for
    those with a column that has holes. Ranks are joined, and no pair is shuffled.
    """
    at = range(len(columns))
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).persist()
    gone = rows.agg(*[F.max(F.col(f"v{i}").isNull()).alias(f"v{i}") for i in at]).first()
    holes = [j for j in at if gone[f"v{j}"]]
    ranked = rows
    for i in at:
        # Ranks less their mean among the rows that have this column, and among those of them that have a column with holes.
        sides = [i, *[j for j in holes if j != i]]
        counts = rows.filter(F.col(f"v{i}").isNotNull()).groupBy(f"v{i}").agg(*[F.sum(F.when(F.col(f"v{j}").isNotNull(), F.col("n")).otherwise(0)).alias(f"s{j}") for j in sides]).persist()
        run = running_totals(counts, f"v{i}", [f"s{j}" for j in sides], kept=True)
        table = run.select(f"v{i}", *[(F.col(f"before_s{j}") + (F.col(f"s{j}") + 1) / 2 - (F.col(f"all_s{j}") + 1) / 2).alias(f"r{i}_{j}") for j in sides])
        ranked = ranked.join(F.broadcast(table) if counts.count() <= BROADCAST_VALUES else table, f"v{i}", "left")
    rank = lambda i, j: F.when(F.col(f"v{j}").isNotNull(), F.col(f"r{i}_{j}" if j in holes else f"r{i}_{i}"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rank(i, j).alias("x"), rank(j, i).alias("y")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    x, y, n = F.col("p.x"), F.col("p.y"), F.col("n")
    sums = ranked.select("n", F.explode(F.array(*pairs)).alias("p")).filter(x.isNotNull() & y.isNotNull()).groupBy("p.a", "p.b").agg(F.sum(n).alias("n"), F.sum(n * x * y).alias("_c"), F.sum(n * x * x).alias("_x"), F.sum(n * y * y).alias("_y"))
    rho = F.when((F.col("_x") > 0) & (F.col("_y") > 0), F.col("_c") / F.sqrt(F.col("_x")) / F.sqrt(F.col("_y")))
    return sums.select("a", "b", "n", F.round(rho, 7).alias("r"))


def correlation_report(df: DataFrame, columns: Sequence[str], method: str = "pearson", most: int = 40, high: float = 0.90) -> DataFrame:
    """Correlations of the first most columns that aren't constant: a, b, r, their places in the tree's order (related ones side by side), the cluster of both if it is one, and whether |r| reaches high.

    A pair that has no correlation counts as 0.
    """
    ends = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    own = [c for c in columns if (ends[c] or 0.0) > 0][:most]
    table = correlations(df, own) if method == "pearson" else rank_correlations(df, own)
    m, at = np.eye(len(own)), {c: i for i, c in enumerate(own)}
    rows = table.select("a", "b", "r").collect() if len(own) > 1 else []  # pairs of columns
    for r in rows:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.r or 0.0
    place = {own[c]: i for i, c in enumerate(leaf_order(linkage(m), len(own)))}
    label = clusters(m)
    out = [(a, b, float(m[at[a], at[b]]), place[a], place[b], label[at[a]] if label[at[a]] == label[at[b]] else None, bool(abs(m[at[a], at[b]]) >= high)) for i, a in enumerate(own) for b in own[i + 1 :]]
    return df.sparkSession.createDataFrame(out, "a string, b string, r double, place_a int, place_b int, cluster int, high boolean")


def representatives(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.7) -> DataFrame:
    """By column its cluster, its information value, and whether it is the one of its cluster to take: that of most information."""
    df = df.select(*dict.fromkeys([*columns, target])).persist()  # read for the correlations and for the screen
    label = clusters(gram(df, columns), threshold)
    iv = {r.column_name: r.iv or 0.0 for r in screen(numeric_screen(df, columns, target)).collect()}  # columns
    df.unpersist()
    best = {k: max((c for c, m in zip(columns, label, strict=True) if m == k), key=lambda c: iv.get(c, 0.0)) for k in set(label)}
    return df.sparkSession.createDataFrame([(c, k, iv.get(c, 0.0), best[k] == c) for c, k in zip(columns, label, strict=True)], "column_name string, cluster int, iv double, recommended boolean")


def gram(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Correlation matrix of columns, over the rows where all are present. weight: a column of counts, of the rows that a row stands for."""
    if weight:
        own = df.dropna(subset=list(columns))
        s = own.agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        centred = [F.col(c) - F.lit(s[f"m{i}"]) for i, c in enumerate(columns)]
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        t = own.agg(*[F.sum(centred[i] * centred[j] * F.col(weight)).alias(f"c{i}_{j}") for i, j in pairs]).first()
        spread = [float(np.sqrt(t[f"c{i}_{i}"] or 0.0)) for i in range(len(columns))]
        m = np.eye(len(columns))
        for i, j in pairs:
            if i != j:
                m[i, j] = m[j, i] = round(t[f"c{i}_{j}"] / (spread[i] * spread[j]), 8) if spread[i] * spread[j] > 0 else 0.0
        return m
    found = correlations(df.dropna(subset=list(columns)), columns).collect()  # pairs of columns
    at, m = {c: i for i, c in enumerate(columns)}, np.eye(len(columns))
    for r in found:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.r if r.r is not None else 0.0
    return m


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation of each column, from the inverse of the correlation matrix."""
    d = np.diag(np.linalg.pinv(gram(df, columns)))
    return df.sparkSession.createDataFrame([(c, round(float(v), 6)) for c, v in zip(columns, d, strict=True)], "column_name string, vif double")


def generalised_vif(matrix: np.ndarray, groups: dict[str, list[int]]) -> dict[str, float]:
    """Fox and Monette's inflation of terms with several columns: det(R11) det(R22) / det(R), to the power 1 / (2 df), squared."""
    whole, out = np.linalg.slogdet(matrix)[1], {}
    for name, own in groups.items():
        rest = [i for i in range(len(matrix)) if i not in own]
        parts = sum(np.linalg.slogdet(matrix[np.ix_(x, x)])[1] for x in (own, rest) if x)
        out[name] = float(np.exp((parts - whole) / len(own)))
    return out
