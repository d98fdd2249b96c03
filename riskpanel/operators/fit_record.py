"""The record of a fit: what each coefficient is worth, which columns a design has twice, and whether the target is separated.

One aggregate gives the covariances of the design's cells; everything else is algebra on that small matrix. A pivoted
Cholesky factorisation tells which cells are linear combinations of others, and of which.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_tail
from . import estimate
from .binning import generalised_vif
from .estimate import Model, Term

#: Events below which a logistic fit separates rather than estimates, and a coefficient that says it did.
LEAST_EVENTS, LARGE = 50, 12.0
#: What is left of a cell's variance, given the cells before it, when it is a combination of them; and a part in such a combination that counts.
TOLERANCE, PART = 1e-8, 0.01


def moments(rows: DataFrame, k: int) -> tuple[int, float, np.ndarray]:
    """Rows, events and covariance matrix of the cells x1 to x(k - 1) of a design with y."""
    pairs = [(i, j) for i in range(1, k) for j in range(i, k)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("e"), *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((k - 1, k - 1))
    for i, j in pairs:
        m[i - 1, j - 1] = m[j - 1, i - 1] = r[f"c{i}_{j}"] or 0.0
    return r.n, r.e or 0.0, m


def correlations_of(covariance: np.ndarray) -> np.ndarray:
    """Correlations; a cell of no variance has none."""
    sd = np.sqrt(np.maximum(np.diag(covariance), 0))
    r = covariance / np.where(sd > 0, sd, 1.0)[:, None] / np.where(sd > 0, sd, 1.0)[None, :]
    np.fill_diagonal(r, 1.0)
    return r


def dependencies(r: np.ndarray, tolerance: float = TOLERANCE, part: float = PART) -> dict[int, list[int]]:
    """Of a correlation matrix each column that is a combination of others, with the columns that it is made of.

    Pivoted Cholesky: the column with most variance left comes next (of equal ones the first), until none has more than
    the tolerance; the columns that are left over depend on those taken.
    """
    k = len(r)
    left, taken = np.ones(k), []
    rows = np.zeros((0, k))
    while len(taken) < k:
        rest = [i for i in range(k) if i not in taken]
        pivot = max(rest, key=lambda i: (round(left[i], 10), -i))
        if left[pivot] <= tolerance:
            break
        row = (r[pivot] - rows[:, pivot] @ rows) / math.sqrt(left[pivot])
        rows, left = np.vstack([rows, row]), left - row**2
        taken.append(pivot)
    out = {}
    for i in sorted(set(range(k)) - set(taken)):
        weights = np.linalg.solve(r[np.ix_(taken, taken)], r[taken, i])
        out[i] = sorted(t for t, w in zip(taken, weights, strict=True) if abs(w) > part)
    return out


@dataclass
class Line:
    """A coefficient with its tests, inflation (infinite for a column in a dependency), and share of the linear predictor's variance."""

    name: str
    term: str | None
    estimate: float
    std_error: float
    z: float
    p_value: float
    vif: float
    term_vif: float
    term_columns: int
    contribution: float


@dataclass
class Record:
    lines: list[Line]
    n: int
    events: int
    log_likelihood: float
    aliased: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    warning: str = ""

    def table(self, spark) -> DataFrame:
        rows = [(x.name, x.term, x.estimate, x.std_error, x.z, x.p_value, None if math.isinf(x.vif) else x.vif, None if math.isinf(x.term_vif) else x.term_vif, x.term_columns, x.contribution, x.name in self.aliased or any(x.name in v for v in self.aliased.values())) for x in self.lines]
        return spark.createDataFrame(rows, "name string, term string, estimate double, std_error double, z double, p_value double, vif double, term_vif double, term_columns int, contribution double, aliased boolean")


def groups_of(terms: Sequence[Term], names: Sequence[str]) -> dict[str, list[int]]:
    """By term the places of its cells among names[1:]; each cell is of one term."""
    at = {n: i for i, n in enumerate(names[1:])}
    return {t.column: own for t in terms if (own := [at[n] for n, _ in t.columns() if n in at])}


def record(model: Model, n: int, events: float, covariance: np.ndarray) -> Record:
    """The record of a fitted model over rows whose cells have this covariance."""
    names, beta, se = model.names, np.array(model.beta), np.array(model.se)
    r, groups = correlations_of(covariance), groups_of(model.terms, model.names)
    tied = dependencies(r)
    involved = set(tied) | {i for own in tied.values() for i in own}
    vif = np.maximum(np.diag(np.linalg.pinv(r, hermitian=True)), 1.0) if len(r) else np.zeros(0)
    free = [i for i in range(len(r)) if i not in tied]
    if tied:  # the others' inflation is that within the columns which are no combinations
        vif[free] = np.maximum(np.diag(np.linalg.inv(r[np.ix_(free, free)])), 1.0)
    vif = np.where([i in involved for i in range(len(r))], np.inf, vif) if len(r) else vif
    of_term = {t: math.inf if any(i in involved for i in own) else 0.0 for t, own in groups.items()}
    sound = [i for t, own in groups.items() if not of_term[t] for i in own]
    if sound:
        within = {t: [sound.index(i) for i in own] for t, own in groups.items() if not of_term[t]}
        for t, v in generalised_vif(r[np.ix_(sound, sound)], within).items():
            of_term[t] = v
    part = beta[1:] ** 2 * np.diag(covariance) if len(r) else np.zeros(0)
    part = part / (part.sum() or 1.0)
    term_of = {i: t for t, own in groups.items() for i in own}
    lines = []
    for i, name in enumerate(names):
        t = term_of.get(i - 1)
        z = float(beta[i] / se[i]) if se[i] > 0 else 0.0
        lines.append(Line(name, t, float(beta[i]), float(se[i]), z, normal_tail(z), float(vif[i - 1]) if i else 1.0, float(of_term.get(t, 1.0)), len(groups.get(t, [])) or 1, float(part[i - 1]) if i else 0.0))
    aliased = {names[i + 1]: [names[j + 1] for j in own] for i, own in tied.items()}
    warning = ""
    if aliased:
        warning = "rank deficient: " + "; ".join(f"{a} = combination of {', '.join(own)}" for a, own in aliased.items())
    elif (np.abs(beta[1:]) > LARGE).any():
        warning = "separated: " + ", ".join(n for n, b in zip(names[1:], beta[1:], strict=True) if abs(b) > LARGE)
    return Record(lines, n, int(events), model.log_likelihood, aliased, model.dropped, warning)


def fit_recorded(train: DataFrame, target: str, treatments: dict[str, str], l2: float = 0.0, terms: list[Term] | None = None, least_events: int = LEAST_EVENTS) -> tuple[Model, Record]:
    """A logistic fit with its record; a window of too few events is refused."""
    events = train.agg(F.coalesce(F.sum(target), F.lit(0)).alias("e")).first().e
    if events < least_events:
        raise ValueError(f"{events:g} events in the estimation window: {least_events} at least are needed")
    model = estimate.fit_logistic(train, target, treatments, l2, terms=terms)
    return model, recorded(train, target, model)


def recorded(train: DataFrame, target: str, model: Model) -> Record:
    """The record of a fitted model over its training rows."""
    rows, names = estimate.design(train.filter(F.col(target).isNotNull()), model.terms, F.col(target).cast("double").alias("y"))
    alive = [i for i, n in enumerate(names) if n not in model.dropped]
    own = rows.select("y", *[F.col(f"x{c}").alias(f"x{i}") for i, c in enumerate(alive)])
    return record(model, *moments(own, len(alive)))


def linear_parts(model: Model) -> dict[str, Column]:
    """By term its part of the linear predictor, of the fitted cells."""
    beta = dict(zip(model.names, model.beta, strict=True))
    return {t.column: sum((c * beta[n] for n, c in t.columns() if n in beta), F.lit(0.0)) for t in model.terms}
