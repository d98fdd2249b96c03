"""Estimation: designs as Column expressions, Gram matrices summed in Spark, logistic and fractional-logit fits.

A fitted transform (edges, weights, knots, means) is a small JSON artefact; applying it is one generated select, so a
score is one codegen stage. A Newton step is one pass over the kept design for all models that are fitted beside each other: tasks
multiply Arrow batches of the different rows and their numbers and send the Gram matrix, the gradient and the likelihood as sums, so the driver gets these numbers only and
no step compiles anything anew. sums() has one step as an aggregate of Columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, counted_mean, sigmoid
from ..functions.special import normal_tail
from . import splines
from ..sources.panels import unpivoted
from .binning import bin_counts, level_counts, value_cells, woe_table
from .ranks import quantiles


@dataclass
class Term:
    """A column's treatment, with what was fitted on which slice.

    scaled; woe and woe_levels (weight of evidence of bins or levels); dummies (indicators of bins, the first is the
    reference; one flag of two bins); dummy_levels and vintage (indicators of levels, the first in order is the reference, as are
    levels that the fit never saw); ordinal (number of the bin, missing values in the first); hinges, or spline, their
    uncorrelated form.
    """

    column: str
    treatment: str
    edges: list[float] = field(default_factory=list)
    levels: dict[str, float] = field(default_factory=dict)
    mean: float = 0.0
    sd: float = 1.0
    missing: float = 0.0
    center: list[float] = field(default_factory=list)
    matrix: list[list[float]] = field(default_factory=list)
    slice: str = ""

    def columns(self) -> list[tuple[str, Column]]:
        x = F.col(self.column)
        if self.treatment == "scaled":
            return [(self.column, (F.coalesce(x.cast("double"), F.lit(self.missing)) - self.mean) / self.sd)]
        if self.treatment == "woe":
            values = [self.levels.get(str(i), 0.0) for i in range(len(self.edges) + 1)]
            return [(self.column, F.when(x.isNull(), F.lit(self.missing)).otherwise(F.array(*map(F.lit, values))[bin_index(x, self.edges)]))]
        if self.treatment == "woe_levels":
            known = F.coalesce(*[F.when(x == k, v) for k, v in self.levels.items()], F.lit(self.levels.get("Other", 0.0)))
            return [(self.column, F.when(x.isNull(), F.lit(self.missing)).otherwise(known))]
        if self.treatment == "dummies":
            at = bin_index(x, self.edges)
            if len(self.edges) == 1 and not self.missing:
                return [(f"{self.column}_flag", F.coalesce((at == 1).cast("double"), F.lit(0.0)))]
            return [(f"{self.column}={i}", (at == i).cast("double")) for i in range(1, len(self.edges) + 1)] + ([(f"{self.column}=Missing", (at == -1).cast("double"))] if self.missing else [])
        if self.treatment == "ordinal":
            return [(f"{self.column}_bin", F.greatest(bin_index(x, self.edges), F.lit(0)).cast("double"))]
        if self.treatment in ("dummy_levels", "vintage"):
            join = "_" if self.treatment == "vintage" else "="
            level = x.cast("long").cast("string") if self.treatment == "vintage" else x.cast("string")
            known = [(f"{self.column}{join}{k}", F.coalesce((level == k).cast("double"), F.lit(0.0))) for k in list(self.levels)[1:]]
            return known + ([(f"{self.column}=Missing", x.isNull().cast("double"))] if self.missing else [])
        if self.treatment == "hinges":
            v = F.coalesce(x.cast("double"), F.lit(self.missing))
            return [(self.column, (v - self.mean) / self.sd)] + [(f"{self.column}>{k:g}", F.greatest(v - k, F.lit(0.0)) / self.sd) for k in self.edges]
        if self.treatment == "spline":
            cells = splines.columns(F.coalesce(x.cast("double"), F.lit(self.missing)), self.edges, self.center, self.matrix)
            return [(f"{self.column}~{i + 1}", c) for i, c in enumerate(cells)]
        raise ValueError(self.treatment)


#: Treatments of numbers, and those of them that need a bin table.
NUMBERS, BINNED = ("scaled", "hinges", "spline", "woe", "dummies", "ordinal"), ("woe", "dummies", "ordinal")


def fit_terms(train: DataFrame, target: str, treatments: dict[str, str], bins: int = 5, weight: str | None = None) -> list[Term]:
    """Fit each column's treatment on the training rows only: all columns from one count table by column and value.

    weight: a column of counts, of the rows that a row stands for.
    """
    numbers = [c for c, how in treatments.items() if how in NUMBERS]
    binned = [c for c in numbers if treatments[c] in BINNED]
    levels = [c for c, how in treatments.items() if how == "woe_levels"]
    rows, kept = train.withColumn("_y", F.col(target)), ["_y", *([weight] if weight else [])]
    mean, q, table, edges, woe = {}, {}, {}, {}, {}
    if numbers:
        own = [F.col(f"`{c}`").cast("double") for c in numbers]
        if weight:
            w = F.col(weight)
            s = train.agg(*[counted_mean(x, w).alias(f"m{i}") for i, x in enumerate(own)]).first().asDict()
            s |= train.agg(*[F.sqrt(counted_mean((x - F.lit(s[f"m{i}"])) * (x - F.lit(s[f"m{i}"])), w)).alias(f"s{i}") for i, x in enumerate(own)]).first().asDict()
        else:
            s = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(own) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        mean = {c: (s[f"m{i}"], s[f"s{i}"] or 1.0) for i, c in enumerate(numbers)}
        long = unpivoted(rows.select(*kept, *[F.col(f"`{c}`").cast("double").alias(c) for c in numbers]), [f"`{c}`" for c in numbers], *kept, names=numbers)
        cells = value_cells(long, "_y", weight=weight)
        q = {r["name"]: r.q for r in quantiles(cells, "value", [0.5, *[i / bins for i in range(1, bins)]], ["name"], weight="n").collect()}
        edges = {c: list(dict.fromkeys(v[1:])) for c, v in q.items()}
        if binned:
            own = train.sparkSession.createDataFrame([(c, edges.get(c, [])) for c in binned], "name string, edges array<double>")
            for r in woe_table(bin_counts(cells.filter(F.col("name").isin(*binned)), own, "e", "n")).collect():  # bins of columns
                table.setdefault(r["name"], {})[str(r.bin)] = r.woe
        cells.unpersist()
    if levels:
        long = unpivoted(rows.select(*kept, *[F.col(f"`{c}`").cast("string").alias(c) for c in levels]), [f"`{c}`" for c in levels], *kept, names=levels)
        for r in woe_table(level_counts(long, "_y", weight=weight)).collect():  # at most 14 levels of each column
            woe.setdefault(r["name"], {})[r.bin] = r.woe
    terms = []
    for column, how in treatments.items():
        if how in ("scaled", "hinges"):
            terms.append(Term(column, how, sorted(edges[column]) if how == "hinges" else [], {}, *mean[column], q[column][0]))
        elif how == "spline":
            terms.append(spline_term(train, column, q[column][1:], q[column][0], weight))
        elif how in ("dummy_levels", "vintage"):
            terms.append(level_term(train, column, how))
        elif how in BINNED:
            own = dict(table.get(column, {}))
            gone = own.pop("-1", None)
            terms.append(Term(column, how, edges.get(column, []), own, missing=(1.0 if gone is not None else 0.0) if how == "dummies" else gone or 0.0))
        else:
            own = woe.get(column, {})
            terms.append(Term(column, "woe_levels", [], own, missing=own.pop("Missing", 0.0)))
    return terms


def level_term(train: DataFrame, column: str, how: str) -> Term:
    """Indicators of the levels that the training rows have; vintages (cast to whole numbers) in their order, others by name."""
    value = F.col(column).cast("long") if how == "vintage" else F.col(column)
    found = [r.level for r in train.groupBy(value.alias("level")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LEVELS + 2).collect()]
    known = sorted(v for v in found if v is not None)
    if len(known) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return Term(column, how, [], {str(v): 0.0 for v in known}, missing=float(how == "dummy_levels" and None in found))


def spline_term(train: DataFrame, column: str, knots: Sequence[float], missing: float, weight: str | None = None) -> Term:
    """A spline with these knots, as far as the training rows straddle them. weight: as fit_terms has it."""
    live, center, matrix = splines.fitted(train, F.coalesce(F.col(column).cast("double"), F.lit(missing)), knots, weight)
    return Term(column, "spline", live, missing=missing, center=center, matrix=matrix)


def design(df: DataFrame, terms: Sequence[Term], *keep: str) -> tuple[DataFrame, list[str]]:
    """keep and the design's cells as columns x0 (1), x1 and so on, with the names of its cells."""
    cells = [("(intercept)", F.lit(1.0)), *[c for t in terms for c in t.columns()]]
    return df.select(*keep, *[c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(cells)]), [n for n, _ in cells]


def counted(rows: DataFrame) -> DataFrame:
    """The different rows of a design with their number n: sums over them are those over all rows, and each Newton step reads these only."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Model:
    """A fit of named design cells. Cells of its terms that aren't among the names had one value in training and were dropped."""

    names: list[str]
    beta: list[float]
    se: list[float]
    log_likelihood: float
    n: int
    terms: list[Term]
    dropped: list[str] = field(default_factory=list)
    slice: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(**{**d, "terms": [Term(**t) for t in d["terms"]]})

    def score(self) -> Column:
        """The predicted rate as one expression on the input columns, of the fitted cells only."""
        cells = [F.lit(1.0), *[c for t in self.terms for n, c in t.columns() if n not in self.dropped]]
        return sigmoid(sum((c * b for c, b in zip(cells, self.beta, strict=True)), F.lit(0.0)))

    def table(self) -> list[tuple]:
        return [(n, b, s, b / s if s else None, normal_tail(b / s) if s else None) for n, b, s in zip(self.names, self.beta, self.se, strict=True)]


#: Levels that indicators are made of, at most.
MOST_LEVELS = 500


def slice_of(df: DataFrame, target: str, columns: Sequence[str]) -> str:
    """Which rows these are, in any order: their number, events, and a sum of row hashes."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(target), F.lit(0)).alias("e"), F.coalesce(F.sum(F.xxhash64(target, *columns).bitwiseAND(0xFFFFF)), F.lit(0)).alias("h")).first()
    return f"{r.n}:{r.e:g}:{r.h}"


def bound(terms: Sequence[Term], where: str) -> list[Term]:
    """The terms, as fitted on a slice; terms of another slice are refused: what they hold would leak between slices."""
    other = [t.column for t in terms if t.slice and t.slice != where]
    if other:
        raise ValueError(f"fitted on other rows: {', '.join(other)}")
    return [replace(t, slice=where) for t in terms]


def sums(rows: DataFrame, beta: np.ndarray, meat: bool = False) -> tuple[np.ndarray, np.ndarray, float, int, np.ndarray]:
    """One aggregate over rows (x0 and so on, y): weighted Gram matrix, gradient, log likelihood, rows, and the residuals' Gram matrix if wanted."""
    k = len(beta)
    x, y, p = [F.col(f"x{i}") for i in range(k)], F.col("y"), F.col("_p")
    eta = sum((c * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))
    own = rows.withColumn("_p", sigmoid(eta)).withColumns({"_w": p * (1 - p), "_r": y - p, "_q": F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))})
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = [F.sum(x[i] * x[j] * F.col("_w")) for i, j in pairs] + [F.sum(c * F.col("_r")) for c in x]
    cells += [F.sum(y * F.log("_q") + (1 - y) * F.log(1 - F.col("_q"))), F.count(F.lit(1))]
    cells += [F.sum(x[i] * x[j] * F.col("_r") * F.col("_r")) for i, j in pairs] if meat else []
    v = [c or 0.0 for c in own.agg(*[c.alias(f"s{i}") for i, c in enumerate(cells)]).first()]

    def square(own: list[float]) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), c in zip(pairs, own, strict=True):
            m[i, j] = m[j, i] = c
        return m

    n = len(pairs)
    return square(v[:n]), np.array(v[n : n + k]), float(v[n + k]), int(v[n + k + 1]), square(v[n + k + 2 :]) if meat else np.zeros((k, k))


def newton(rows: DataFrame, k: int, l2: float = 0.0, steps: int = 25, tol: float = 1e-8, rate: float | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Maximum likelihood with a ridge on all but the intercept: coefficients, information with the ridge, log likelihood and rows."""
    return newton_many(rows, {"": list(range(k))}, l2, steps, tol, rate)[""]


def weighted(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """y, the named cells and n, the rows that each row stands for (1 without such a column)."""
    return rows.select("y", *names, (F.col("n") if "n" in rows.columns else F.lit(1)).cast("double").alias("n"))


def summing(trials: dict[str, tuple[list[int], np.ndarray]], names: list[str], partial: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums for each trial (its cells and coefficients): information, gradient, likelihood and rows, as one list.

    A row counts n times. partial: a trial leaves out the rows in which one of its cells is missing.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if batch.num_rows else np.zeros((0, len(names)))
            y, n = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "n")]
            gone = np.isnan(x)
            holes = partial and gone.any()
            for name, (cells, beta) in trials.items():
                kept = ~gone[:, cells].any(axis=1) if holes else slice(None)
                own, t, w = x[kept][:, cells], y[kept], n[kept]
                p = 1 / (1 + np.exp(-np.clip(own @ beta, -35, 35)))
                q = np.clip(p, 1e-12, 1 - 1e-12)
                parts = [((own * (w * p * (1 - p))[:, None]).T @ own).ravel(), own.T @ (w * (t - p)), [(w * (t * np.log(q) + (1 - t) * np.log(1 - q))).sum(), w.sum()]]
                totals[name] = totals.get(name, 0.0) + np.concatenate(parts)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], ["trial", "s"])

    return sums


def newton_many(rows: DataFrame, trials: dict[str, list[int]], l2: float = 0.0, steps: int = 25, tol: float = 1e-8, rate: float | None = None, start: dict[str, np.ndarray] | None = None, partial: bool = False) -> dict[str, tuple[np.ndarray, np.ndarray, float, int]]:
    """Fits of many subsets of a design's cells at once: by trial (its cells, of which 0 is the intercept) what newton() gives.

    A step is one pass over the rows for all trials: a task multiplies its batches and sends one list of sums for each
    trial, which Spark adds up by place, so the driver gets k (k + 1) + 2 numbers of each. A move that lowers the likelihood is
    halved. rate: the mean of y, from whose log odds intercepts begin; start: coefficients to begin from. Where rows have a
    column n, each stands for so many rows. partial: each trial is fitted on the rows that have all of its cells.
    """
    names = [f"x{i}" for i in sorted({c for own in trials.values() for c in own})]
    at = {n: i for i, n in enumerate(names)}
    cells = {t: [at[f"x{c}"] for c in own] for t, own in trials.items()}
    first = np.log(rate / (1 - rate)) if rate and 0 < rate < 1 else 0.0
    beta = {t: np.array((start or {}).get(t, [first, *[0.0] * (len(c) - 1)]), float) for t, c in cells.items()}
    penalty = {t: l2 * np.diag([0.0, *[1.0] * (len(c) - 1)]) for t, c in cells.items()}
    known: dict[str, tuple] = {}
    move = {t: np.zeros_like(b) for t, b in beta.items()}
    halved = dict.fromkeys(beta, 0)
    live = set(beta)
    for _ in range(6 * steps):
        own = {t: (cells[t], beta[t] + move[t]) for t in live}
        # Lists of one trial are added place by place; there are as many as tasks.
        lists = weighted(rows, names).mapInArrow(summing(own, names, partial), "trial string, s array<double>").select("trial", F.posexplode("s").alias("i", "v"))
        found: dict[str, dict[int, float]] = {}
        for r in lists.groupBy("trial", "i").agg(F.sum("v").alias("v")).collect():
            found.setdefault(r["trial"], {})[r["i"]] = r["v"]
        for t in list(live):
            k = len(cells[t])
            s = np.array([found.get(t, {}).get(i, 0.0) for i in range(k * k + k + 2)])
            h, g, ll, n = s[: k * k].reshape(k, k), s[k * k : k * k + k], float(s[-2]), int(s[-1])
            now, value = beta[t] + move[t], lambda b, v, t=t: v - 0.5 * b @ penalty[t] @ b
            if t in known and value(now, ll) < value(beta[t], known[t][2]) - 1e-9 * abs(ll) and halved[t] < 6:
                move[t], halved[t] = move[t] / 2, halved[t] + 1
                continue
            ended = t in known and np.abs(move[t]).max() < tol
            beta[t], known[t], halved[t] = now, (h, g, ll, n, known.get(t, (0,) * 5)[4] + 1), 0
            move[t] = np.linalg.lstsq(h + penalty[t], g - penalty[t] @ now, rcond=None)[0]
            if ended or known[t][4] > steps:
                live.discard(t)
        if not live:
            break
    return {t: (beta[t], known[t][0] + penalty[t], known[t][2], known[t][3]) for t in trials}


def meats(rows: DataFrame, trials: dict[str, tuple[list[int], np.ndarray]]) -> dict[str, np.ndarray]:
    """By trial (its cells and coefficients) the Gram matrix of cells times residuals, the middle of a sandwich: all in one pass."""
    names = [f"x{i}" for i in sorted({c for own, _ in trials.values() for c in own})]
    own = {t: ([names.index(f"x{c}") for c in cells], np.asarray(beta, float)) for t, (cells, beta) in trials.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
            y, n = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "n")]
            for t, (cells, beta) in own.items():
                z = x[:, cells]
                z = z * (np.sqrt(n) * (y - 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))))[:, None]
                totals[t] = totals.get(t, 0.0) + (z.T @ z).ravel()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], ["trial", "s"])

    lists = weighted(rows, names).mapInArrow(sums, "trial string, s array<double>").select("trial", F.posexplode("s").alias("i", "v"))
    out = {t: np.zeros(len(c) ** 2) for t, (c, _) in own.items()}
    for r in lists.groupBy("trial", "i").agg(F.sum("v").alias("v")).collect():  # k^2 numbers of each trial
        out[r["trial"]][r["i"]] = r["v"]
    return {t: v.reshape(len(own[t][0]), -1) for t, v in out.items()}


def fit_logistic(train: DataFrame, target: str, treatments: dict[str, str], l2: float = 0.0, robust: bool = False, terms: list[Term] | None = None) -> Model:
    """A logistic fit of a 0/1 target, or (robust) a fractional-logit fit of a share with sandwich standard errors.

    Design cells of one value on the training rows are dropped and named. Terms that are given must be of these rows, or of
    no slice in particular.
    """
    columns = list(dict.fromkeys(treatments if terms is None else [t.column for t in terms]))
    needed = list(dict.fromkeys([*columns, target]))
    train = train.select(*[F.col(f"`{c}`") for c in needed]).filter(F.col(target).isNotNull()).persist()
    where = slice_of(train, target, [f"`{c}`" for c in columns])
    terms = bound(fit_terms(train, target, treatments) if terms is None else terms, where)
    rows, names = design(train, terms, F.col(target).cast("double").alias("y"))
    rows = counted(rows).persist()
    s = rows.agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("rate"), *[F.stddev_pop(f"x{i}").alias(f"x{i}") for i in range(1, len(names))]).first()
    train.unpersist()
    alive = [0, *[i for i in range(1, len(names)) if (s[f"x{i}"] or 0.0) > 1e-12]]
    own = rows if len(alive) == len(names) else rows.select("y", "n", *[F.col(f"x{c}").alias(f"x{i}") for i, c in enumerate(alive)])
    beta, h, ll, n = newton(own, len(alive), l2, rate=s.rate)
    inverse = np.linalg.pinv(h)
    if robust:
        inverse = inverse @ meats(own, {"": (list(range(len(alive))), beta)})[""] @ inverse
    rows.unpersist()
    return Model([names[i] for i in alive], beta.tolist(), np.sqrt(np.maximum(np.diag(inverse), 0)).tolist(), ll, n, terms, [n for i, n in enumerate(names) if i not in alive], where)


def ridge(regularization: float, rows: int) -> float:
    """The ridge of a regularization: it grows with the rows, so that its weight beside the likelihood stays."""
    return max(regularization, 1e-6) * rows / 1000.0


def fit_l1(train: DataFrame, target: str, terms: list[Term], c: float) -> dict[str, float]:
    """Coefficients of an L1-penalised logistic fit, by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows, names = design(train, terms, F.col(target).cast("double").alias("y"))
    ready = rows.select("y", array_to_vector(F.array(*[F.col(f"x{i}") for i in range(1, len(names))])).alias("features"))
    model = LogisticRegression(labelCol="y", elasticNetParam=1.0, standardization=False, regParam=1 / (c * max(train.count(), 1)), maxIter=300, tol=1e-9).fit(ready)
    return dict(zip(names, [model.intercept, *model.coefficients.toArray().tolist()], strict=True))


def prior_correction(model: Model, kept_share: float) -> Model:
    """The intercept for all rows, of a fit on all events and a share of the non-events."""
    return replace(model, beta=[model.beta[0] + float(np.log(kept_share)), *model.beta[1:]])
