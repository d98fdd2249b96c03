"""Search for severity models: cores by robust Wald tests, macro terms beside them, and all their combinations measured
before and after a boundary.

The likelihood of a fractional-logit fit is none, so its ratios and criteria decide nothing here: the sandwich
standard errors do. Rows are defaults of known severity (severity.observed) with the macro terms as columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_tail
from ..operators import estimate
from ..operators.severity import LEAST_TEST
from .search import Rules, Trials, cyclical

#: Fits whose errors one aggregate measures.
AT_ONCE = 40
FITS = (
    "core string, terms array<string>, columns array<string>, n_train long, n_test long, log_likelihood double, bic double, max_p double, max_inflation double, "
    "shifted array<string>, mae_in double, mae_oot double, rmse_oot double, rises boolean, filtered string"
)


class SeverityTrials(Trials):
    """Trials of scaled columns with robust tests."""

    def __init__(self, rows: DataFrame, severity: str, columns: Sequence[str]) -> None:
        super().__init__(rows, severity, dict.fromkeys(columns, "scaled"))
        self.wald: dict[tuple, dict[str, tuple[float, float, float]]] = {}

    def test_all(self, subsets: Sequence[Sequence[str]]) -> None:
        """Fit and test those of the subsets that aren't yet, all in the same passes."""
        self.fit_all(subsets)
        new = {k for k in (tuple(sorted(x)) for x in subsets) if k not in self.wald}
        if not new:
            return
        meat = estimate.meats(self.rows, {"|".join(k): (self.cells(k), self.known[k][1]) for k in new})
        for key in new:
            _, beta, h = self.known[key]
            inverse = np.linalg.pinv(h)
            se = np.sqrt(np.maximum(np.diag(inverse @ meat["|".join(key)] @ inverse), 0))
            self.wald[key] = {c: (float(b), float(s), normal_tail(float(b / s)) if s else 1.0) for c, b, s in zip(("", *key), beta, se, strict=True)}

    def tested(self, chosen: Sequence[str]) -> dict[str, tuple[float, float, float]]:
        """Coefficient, robust standard error and p-value by column, and of the intercept as ""."""
        self.test_all([chosen])
        return self.wald[tuple(sorted(chosen))]

    def correlation(self, a: str, b: str) -> float:
        self.inflation([a, b])
        return abs(float(self.r[self.places[a][0] - 1, self.places[b][0] - 1]))

    def model(self, chosen: Sequence[str]) -> estimate.Model:
        t, key = self.tested(chosen), sorted(chosen)
        names = ["", *key]
        return estimate.Model(["(intercept)", *key], [t[c][0] for c in names], [t[c][1] for c in names], self.fitted(key)[0], 0, [self.terms[c] for c in key])


def cores_of(trials: SeverityTrials, candidates: Sequence[str], rules: Rules = Rules(), expert: Sequence[str] = ()) -> dict[str, list[tuple[str, str, float]]]:
    """Cores by name (stepwise, strong, expert) with the trace of each, as search.cores gives them; values are robust p-values.

    The column of least p enters while that is below rules.enter and every inflation within the cap. What stays out
    is in the trace with what kept it out: blocked (inflation) or rejected (its p beside the core). strong: the
    rules.strong columns without which most quasi-likelihood is lost, if the core has more (keep: twice that loss).
    """
    open_to = [c for c in candidates if c in trials.terms]
    trace = [("unfit", c, 0.0) for c in candidates if c in trials.constant]
    chosen: list[str] = []
    while True:
        rest = [c for c in open_to if c not in chosen]
        trials.test_all([[*chosen, c] for c in rest])
        p = {c: trials.tested([*chosen, c])[c][2] for c in rest}
        paying = {c: v for c, v in p.items() if v < rules.enter}
        worst = {c: trials.inflation([*chosen, c]) if rules.inflation else 1.0 for c in paying}
        blocked = {c: v for c, v in worst.items() if rules.inflation and v > rules.inflation}
        paying = {c: v for c, v in paying.items() if c not in blocked}
        if not paying or (rules.most is not None and len(chosen) >= rules.most):
            break
        # Of p-values that are 0 to the last digit the greater test statistic decides.
        best = min(paying, key=lambda c: (paying[c], -abs(trials.tested([*chosen, c])[c][0] / trials.tested([*chosen, c])[c][1])))
        chosen.append(best)
        trace.append(("enter", best, paying[best]))
    trace += [("blocked", c, v) for c, v in sorted(blocked.items())]
    trace += [("rejected", c, p[c]) for c in rest if c not in blocked]
    found: dict[str, tuple[list[str], list]] = {}

    def add(name: str, columns: Sequence[str], steps: list) -> None:
        if columns and all(set(columns) != set(c) for c, _ in found.values()):
            found[name] = list(columns), [*steps, *[("cyclical", c, 0.0) for c in cyclical(columns)]]

    add("stepwise", chosen, trace)
    if len(chosen) > rules.strong:
        trials.fit_all([chosen, *[[x for x in chosen if x != c] for c in chosen]])
        loss = {c: 2 * (trials.fitted(chosen)[0] - trials.fitted([x for x in chosen if x != c])[0]) for c in chosen}
        kept = sorted(sorted(chosen, key=lambda c: -loss[c])[: rules.strong], key=chosen.index)
        add("strong", kept, [("keep", c, loss[c]) for c in kept])
    named = [c for c in expert if c in trials.terms]
    add("expert", named, [("expert", c, trials.tested(named)[c][2]) for c in named])
    return {name: steps for name, (_, steps) in found.items()}


def columns_of(trace: Sequence[tuple[str, str, float]]) -> list[str]:
    """A core's columns, from its trace."""
    return [c for a, c, _ in trace if a in ("enter", "keep", "expert")]


def screened(trials: SeverityTrials, core: Sequence[str], terms: Sequence[str], rules: Rules = Rules()) -> list[tuple[str, float | None, str]]:
    """By macro term: its robust p beside the core, and why it is left out (empty: it stays). A loose cutoff; signs are not asked for."""
    out: list[tuple[str, float | None, str]] = []
    trials.test_all([[*core, t] for t in terms if t in trials.terms])
    for term in terms:
        if term not in trials.terms:
            out.append((term, None, "one value"))
            continue
        p = trials.tested([*core, term])[term][2]
        out.append((term, p, "" if p <= rules.screen else "p"))
    return out


def combinations_of(trials: SeverityTrials, terms: Sequence[str], most: int = 3, limit: float = 0.7) -> list[tuple[str, ...]]:
    """Sets of 1 to most terms (key@transform@lag) of different series whose columns don't correlate above the limit."""
    family = lambda t: t.split("@")[0].removesuffix("_yoy").removesuffix("_growth")
    return [c for size in range(1, most + 1) for c in combinations(terms, size) if len({family(t) for t in c}) == size and all(trials.correlation(a, b) <= limit for a, b in combinations(c, 2))]


def rises(coefficients: dict[str, float], rows: Sequence, order: Sequence[str]) -> bool:
    """Whether the greatest move of the predictor since each path's first month grows along the order of scenarios, and ends above 0."""
    peaks = []
    for scenario in order:
        own = [r for r in rows if r["scenario"] == scenario]
        value = [sum(b * (r[t] or 0.0) for t, b in coefficients.items()) for r in own]
        peaks.append(max((v - value[0] for v in value[1:]), default=0.0))
    return bool(peaks) and all(b >= a - 1e-12 for a, b in zip(peaks, peaks[1:], strict=False)) and peaks[-1] > 0


def fits(seen: DataFrame, severity: str, cores: dict[str, Sequence[str]], terms: Sequence[str], boundary: str, rules: Rules = Rules(), most: int = 3, shift: float = 0.30, paths: DataFrame | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Each core alone and with each combination of the terms that pass beside it, one row for each set of columns.

    Fitted on rows before the boundary. shifted: core columns whose coefficient turned its sign or moved by more than shift of
    itself against the core alone. mae_oot and rmse_oot are null under LEAST_TEST later rows. filtered names the
    rule that a fit breaks: p (a column above rules.leave), inflation, or stress. paths: scenario, month and the terms' values, from a
    date on; order: scenarios from the mildest on. rises: whether the peak of the macro terms' part of the
    predictor, from the first month on, grows from scenario to scenario and is above 0 in the severest (null: no terms or paths).
    """
    late = F.col("performance_date") >= F.lit(boundary).cast("date")
    every = list(dict.fromkeys([*[c for core in cores.values() for c in core], *terms]))
    seen = seen.select("performance_date", severity, *every).persist()
    trials = SeverityTrials(seen.filter(~late), severity, every)
    sets: dict[tuple[str, ...], tuple[str, tuple[str, ...]]] = {}
    for name, core in cores.items():
        core = [c for c in core if c in trials.terms]
        passed = [t for t, _, why in screened(trials, core, [t for t in terms if t not in core], rules) if not why]
        for combo in [(), *combinations_of(trials, passed, most)]:
            sets.setdefault(tuple(sorted([*core, *combo])), (name, combo))
    trials.test_all([*[k for k in sets if k], *[[c for c in k if c not in combo] for k, (_, combo) in sets.items() if set(k) - set(combo)]])
    # Months by scenarios: a few hundred rows.
    ahead = paths.orderBy("month").collect() if paths is not None else []
    models = {key: trials.model(key) for key in sets if key}
    errors: dict[tuple, tuple] = {}
    for at in range(0, len(models), AT_ONCE):
        own = list(models.items())[at : at + AT_ONCE]
        gap = [F.col(severity) - m.score() for _, m in own]
        cells = [c.alias(f"{n}{i}") for i, g in enumerate(gap) for n, c in (("a", F.avg(F.when(~late, F.abs(g)))), ("b", F.avg(F.when(late, F.abs(g)))), ("c", F.sqrt(F.avg(F.when(late, g * g)))))]
        r = seen.agg(F.count_if(~late).alias("n"), F.count_if(late).alias("m"), *cells).first()
        for i, (key, _) in enumerate(own):
            errors[key] = (r.n, r.m, r[f"a{i}"], *((r[f"b{i}"], r[f"c{i}"]) if r.m >= LEAST_TEST else (None, None)))
    out = []
    for key in models:
        name, combo = sets[key]
        core = [c for c in key if c not in combo]
        now, alone = trials.tested(key), trials.tested(core) if core else {}
        n, m, mae_in, mae_oot, rmse_oot = errors[key]
        moved = [c for c in core if now[c][0] * alone[c][0] < 0 or abs(now[c][0] - alone[c][0]) > shift * abs(alone[c][0])]
        p, inflation, ll = max(now[c][2] for c in key), trials.inflation(key), trials.fitted(key)[0]
        steep = {t: now[t][0] / trials.terms[t].sd for t in combo}
        up = rises(steep, ahead, order) if combo and ahead else None
        why = "p" if p > rules.leave else "inflation" if rules.inflation and inflation > rules.inflation else "stress" if up is False else None
        r = lambda v, d=6: None if v is None else round(float(v), d)
        out.append((name, list(combo), list(key), n, m, r(ll), r(len(key) * math.log(max(n, 1)) - 2 * ll), r(p, 8), r(inflation), moved, r(mae_in, 8), r(mae_oot, 8), r(rmse_oot, 8), up, why))
    trials.close()
    seen.unpersist()
    return seen.sparkSession.createDataFrame(out, FITS)
