"""Search: cores by stepwise choice of terms, macro terms beside them, joint fits of combinations, and the full model run."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sigmoid
from ..functions.special import chi2_tail, normal_tail
from ..operators import binning, estimate, evaluate, frames


#: Marks of columns that move with the cycle, and may take up what macro terms should explain (fixed values).
CYCLICAL = ("current_ltv", "cltv", "utilization", "utilisation", "delinq", "dpd")


def cyclical(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(m in c.lower() for m in CYCLICAL)]


@dataclass(frozen=True)
class Rules:
    """How terms enter and leave: by p-value, or by AIC or BIC, whose penalty counts events, and a cap on inflation (None: no cap).

    frame: rows that trials of cores and of a macro screen are fitted on at most; all events are among them (None: all rows).
    joint_rows fits on all rows.
    """

    metric: str = "bic"
    enter: float = 0.01
    leave: float = 0.05
    screen: float = 0.10
    most: int | None = None
    inflation: float | None = 5.0
    strong: int = 4
    frame: int | None = frames.SCREEN_ROWS

    def __post_init__(self) -> None:
        if self.metric not in ("p_value", "aic", "bic"):
            raise ValueError(self.metric)

    def gain(self, lr: float, df: int, events: float, limit: float) -> tuple[bool, float]:
        """Whether df more parameters pay for a likelihood ratio of lr, and a score that is less for a stronger term."""
        if self.metric == "p_value":
            p = chi2_tail(max(lr, 0.0), max(df, 1))
            return p < limit, p
        delta = df * (2.0 if self.metric == "aic" else math.log(max(events, 2))) - lr
        return delta < 0, delta


class Trials:
    """The designs of all candidates, fitted and kept once (equal rows as one with their number), on an event-preserving frame of exactly so many rows.

    Any subsets of them are fitted beside each other, without another read of the input: a Newton step of all trials of
    a pass is one aggregate. weight: a column of counts of train, which is kept already, holds the different rows and is fitted
    as a whole; designs are then made of it in each pass.
    """

    def __init__(self, train: DataFrame, target: str, candidates: dict[str, str], frame: int | None = None, weight: str | None = None) -> None:
        whole = train.select(target, *candidates, *([weight] if weight else [])).filter(F.col(target).isNotNull())
        whole = whole if weight else whole.persist()  # a frame takes several passes
        train = frames.event_frame(whole, target, frame).rows.persist() if frame and not weight else whole
        ends = train.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(candidates)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(candidates)]).first()
        #: Columns of one value, or none, which no fit can estimate.
        self.constant = [c for i, c in enumerate(candidates) if ends[f"a{i}"] == ends[f"b{i}"]]
        own = {c: how for c, how in candidates.items() if c not in self.constant}
        self.terms = dict(zip(own, estimate.fit_terms(train, target, own, weight=weight), strict=True))
        self.places, at = {}, 1
        for c, t in self.terms.items():
            self.places[c] = list(range(at, at + len(t.columns())))
            at += len(t.columns())
        self.width = at
        rows, _ = estimate.design(train, list(self.terms.values()), F.col(target).cast("double").alias("y"), *([F.col(weight).alias("n")] if weight else []))
        self.rows = rows if weight else estimate.counted(rows).persist()
        events = F.sum(F.col("y") * F.col("n"))
        s = self.rows.agg((events / F.sum("n")).alias("rate"), events.alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        self.n = s.n
        self.rate, self.events, self.known, self.r = s.rate, s.events or 0.0, {}, None
        train.unpersist()
        whole.unpersist()

    def cells(self, key: Sequence[str]) -> list[int]:
        return [0, *[i for c in key for i in self.places[c]]]

    def fit_all(self, subsets: Sequence[Sequence[str]]) -> None:
        """Fit those of the subsets that aren't yet, all at once, each from the coefficients of a known one with a term more or less."""
        new = {k for k in (tuple(sorted(x)) for x in subsets) if k not in self.known}
        if not new:
            return
        start = {}
        for key in new:
            near = next((k for k in self.known if len(set(k) ^ set(key)) == 1), None)
            if near is not None:
                old = dict(zip(self.cells(near), self.known[near][1], strict=True))
                start["|".join(key)] = np.array([old.get(c, 0.0) for c in self.cells(key)])
        fits = estimate.newton_many(self.rows, {"|".join(k): self.cells(k) for k in new}, steps=10, tol=1e-6, rate=self.rate, start=start)
        for key in new:
            beta, h, ll, _ = fits["|".join(key)]
            self.known[key] = ll, beta, h

    def fitted(self, chosen: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, coefficients and information matrix; a subset is fitted once."""
        self.fit_all([chosen])
        return self.known[tuple(sorted(chosen))]

    def width_of(self, column: str) -> int:
        return len(self.places[column])

    def inflation(self, chosen: Sequence[str]) -> float:
        """The greatest generalised inflation of the chosen terms; correlations of all cells are summed once."""
        if len(chosen) < 2:
            return 1.0
        if self.r is None:
            self.r = binning.gram(self.rows, [f"x{i}" for i in range(1, self.width)], "n")
        cells = [i - 1 for c in chosen for i in self.places[c]]
        groups, at = {}, 0
        for c in chosen:
            groups[c] = list(range(at, at + self.width_of(c)))
            at += self.width_of(c)
        return max(binning.generalised_vif(self.r[np.ix_(cells, cells)], groups).values())

    def close(self) -> None:
        self.rows.unpersist()


def forward(train: DataFrame, target: str, candidates: dict[str, str], enter: float = 0.05, most: int = 8, tell: Callable[[str], None] | None = None) -> list[tuple[str, float]]:
    """Columns in the order in which they enter, with their p-values: each is the best by likelihood ratio given those before."""
    trials = Trials(train, target, candidates)
    chosen: list[tuple[str, float]] = []
    while len(chosen) < most:
        own = [c for c, _ in chosen]
        trials.fit_all([own, *[[*own, c] for c in trials.terms if c not in own]])
        now = trials.fitted(own)[0]
        gains = {c: trials.fitted([*own, c])[0] - now for c in trials.terms if c not in own}
        if not gains:
            break
        best = max(gains, key=gains.get)
        p = chi2_tail(max(0.0, 2 * gains[best]), trials.width_of(best))
        if p > enter:
            break
        chosen.append((best, p))
        if tell:
            tell(f"{best} enters, p = {p:.3g}")
    trials.close()
    return chosen


def cores(train: DataFrame, target: str, candidates: dict[str, str], rules: Rules = Rules(), expert: Sequence[str] = (), tell: Callable[[str], None] | None = None) -> dict[str, list[tuple[str, str, float]]]:
    """Cores by name (stepwise, strong, expert), each the trace of its building: (action, column, value).

    stepwise: the best term enters while one pays and keeps every inflation within the cap; then the weakest leaves while
    it doesn't pay. strong: its rules.strong terms of greatest likelihood ratio, if it has more. expert: the given list.
    Actions: unfit (one value), enter and leave (score), blocked (the inflation that kept it out), keep (likelihood ratio),
    expert (likelihood ratio), cyclical (a warning). A core of the same columns as one before it is left out.
    """
    trials = Trials(train, target, candidates, rules.frame)
    trace = [("unfit", c, 0.0) for c in trials.constant]
    chosen: list[str] = []
    blocked: dict[str, float] = {}

    def drop(c: str, own: Sequence[str]) -> float:
        return 2 * (trials.fitted(own)[0] - trials.fitted([x for x in own if x != c])[0])

    while rules.most is None or len(chosen) < rules.most:
        trials.fit_all([chosen, *[[*chosen, c] for c in trials.terms if c not in chosen]])
        paying = {}
        for c in trials.terms:
            if c in chosen:
                continue
            pays, score = rules.gain(drop(c, [*chosen, c]), trials.width_of(c), trials.events, rules.enter)
            worst = trials.inflation([*chosen, c]) if pays and rules.inflation else 1.0
            if pays and rules.inflation and worst > rules.inflation:
                blocked[c] = worst
            elif pays:
                paying[c] = score
        if not paying:
            break
        best = min(paying, key=paying.get)
        chosen.append(best)
        blocked.pop(best, None)
        trace.append(("enter", best, paying[best]))
        if tell:
            tell(f"{best} enters")
    trace += [("blocked", c, v) for c, v in sorted(blocked.items())]
    while len(chosen) > 1:
        trials.fit_all([chosen, *[[x for x in chosen if x != c] for c in chosen]])
        scores = {c: rules.gain(drop(c, chosen), trials.width_of(c), trials.events, rules.leave) for c in chosen}
        idle = {c: score for c, (pays, score) in scores.items() if not pays}
        if not idle:
            break
        worst = max(idle, key=idle.get)
        chosen.remove(worst)
        trace.append(("leave", worst, idle[worst]))
    found: dict[str, tuple[list[str], list]] = {}

    def add(name: str, columns: Sequence[str], steps: list) -> None:
        if columns and all(set(columns) != set(c) for c, _ in found.values()):
            found[name] = list(columns), [*steps, *[("cyclical", c, 0.0) for c in cyclical(columns)]]

    add("stepwise", chosen, trace)
    if len(chosen) > rules.strong:
        trials.fit_all([[x for x in chosen if x != c] for c in chosen])
        lr = {c: drop(c, chosen) for c in chosen}
        kept = sorted(sorted(chosen, key=lambda c: -lr[c])[: rules.strong], key=chosen.index)
        add("strong", kept, [("keep", c, lr[c]) for c in kept])
    named = [c for c in expert if c in trials.terms]
    trials.fit_all([named, *[[x for x in named if x != c] for c in named]])
    add("expert", named, [("expert", c, drop(c, named)) for c in named])
    trials.close()
    return {name: steps for name, (_, steps) in found.items()}


def macro_screen(train: DataFrame, target: str, core: dict[str, str], priors: dict[str, int | None], rules: Rules = Rules()) -> DataFrame:
    """By macro term, fitted beside the core: coefficient, p, whether it is kept, and why not: its sign is against the
    prior (None: no prior), its p is not within the screen, or it has one value only.
    """
    trials = Trials(train, target, {**core, **{t: "scaled" for t in priors}}, rules.frame)
    own, out = [c for c in core if c in trials.terms], []
    trials.fit_all([own])
    trials.fit_all([[*own, t] for t in priors if t in trials.terms])
    for term, prior in priors.items():
        if term not in trials.terms:
            out.append((term, None, None, False, "one value"))
            continue
        names = sorted([*own, term])
        _, beta, h = trials.fitted(names)
        at = 1 + sum(trials.width_of(c) for c in names[: names.index(term)])
        se = math.sqrt(max(float(np.linalg.pinv(h)[at, at]), 0.0))
        b, p = float(beta[at]), normal_tail(float(beta[at]) / se) if se else 1.0
        why = "sign" if prior is not None and (1 if b > 0 else -1) != prior else "p" if p >= rules.screen else ""
        out.append((term, round(b, 6), round(p, 8), not why, why))
    trials.close()
    return train.sparkSession.createDataFrame(out, "term string, beta double, p_value double, kept boolean, reason string")


def joint_fits(rows: DataFrame, target: str, combos: dict[str, list[str]], steps: int = 30, tol: float = 1e-8) -> DataFrame:
    """Logistic fits of all combinations at once: combo, n, log likelihood, BIC on events, and coefficients.

    Equal rows are one with their number. A Newton step is one pass over these for all combinations, each of which leaves out
    the rows where one of its columns is missing; the driver gets a small Gram matrix of each.
    """
    every = list(dict.fromkeys(c for x in combos.values() for c in x))
    rows = rows.select(F.coalesce(F.col(target), F.lit(0)).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in every])
    rows = estimate.counted(rows).persist()
    whole = lambda columns: F.lit(True) if not columns else F.forall(F.array(*[F.col(c).isNotNull() & ~F.isnan(c) for c in columns]), lambda x: x)
    events = [F.sum(F.when(whole(columns), F.col("y") * F.col("n"))).alias(f"e{i}") for i, columns in enumerate(combos.values())]
    ends = rows.agg(*[F.max(F.abs(c)).alias(f"m{i}") for i, c in enumerate(every)], *events).first()
    scale = {c: max(ends[f"m{i}"] or 0.0, 1e-12) for i, c in enumerate(every)}
    cells = {c: i + 1 for i, c in enumerate(every)}
    scaled = rows.select("y", "n", F.lit(1.0).alias("x0"), *[(F.col(c) / scale[c]).alias(f"x{cells[c]}") for c in every])
    fits = estimate.newton_many(scaled, {name: [0, *[cells[c] for c in columns]] for name, columns in combos.items()}, steps=steps, tol=tol, partial=True)
    rows.unpersist()
    out = []
    for i, (name, columns) in enumerate(combos.items()):
        beta, _, ll, n = fits[name]
        if n:
            bic = -2 * ll + (len(columns) + 1) * math.log(max(ends[f"e{i}"], 1))
            beta = [beta[0], *[b / scale[c] for b, c in zip(beta[1:], columns, strict=True)]]
            out.append((name, n, round(float(ll), 5), round(float(bic), 5), [round(float(v), 8) for v in beta]))
    return rows.sparkSession.createDataFrame(out, "combo string, n long, log_likelihood double, bic double, beta array<double>")


JOINT = (
    "core string, terms array<string>, columns array<string>, n long, events long, log_likelihood double, bic double, max_p double, max_inflation double, shifted array<string>, "
    "wrong_signs array<string>, auc_in double, ks_in double, auc_oot double, ks_oot double, filtered string"
)


def joint_rows(rows: DataFrame, target: str, boundary: str, cores: dict[str, Sequence[str]], treatments: dict[str, str], combos: Sequence[Sequence[str]], priors: dict[str, int | None], rules: Rules = Rules(), shift: float = 0.30, at_once: int = 40) -> DataFrame:
    """Each core alone and with each combination of macro terms, one row for each set of columns.

    All sets are fitted beside each other on all rows before the boundary, and scored on these and on all later rows; their AUC and
    KS are one aggregate for at_once models. The rows are read once: fits and scores are sums over one kept table of the different
    values of all columns and terms, with the target and their number. shifted: core columns of which a
    coefficient turned its sign or moved by more than shift of itself against the core alone. wrong_signs: terms against
    their prior. filtered names the rule that a fit breaks: p (a single-column term above rules.leave), inflation or sign.
    """
    early = F.col("performance_date") < F.lit(boundary).cast("date")
    every = {**{c: treatments[c] for core in cores.values() for c in core}, **{t: "scaled" for combo in combos for t in combo}}
    own = rows.filter(F.col(target).isNotNull()).groupBy(F.when(early, "in").otherwise("oot").alias("slice"), *every, target).agg(F.count(F.lit(1)).alias("_n")).persist()
    trials = Trials(own.filter("slice = 'in'"), target, every, weight="_n")
    sets: dict[tuple[str, ...], tuple[str, tuple[str, ...]]] = {}
    for name, core in cores.items():
        core = [c for c in core if c in trials.terms]
        for combo in [(), *combos]:
            if core and all(t in trials.terms for t in combo):
                sets.setdefault(tuple(sorted([*core, *combo])), (name, tuple(combo)))
    trials.fit_all(list(sets))
    alone = {name: tuple(sorted(c for c in core if c in trials.terms)) for name, core in cores.items()}
    trials.fit_all([a for a in alone.values() if a])
    # A core's models are scored on the different values of its columns and terms only, with their rows and events.
    power: dict[tuple, tuple] = {}
    for at in range(0, len(sets), at_once):
        keys, long = list(sets)[at : at + at_once], None
        for core in dict.fromkeys(sets[key][0] for key in keys):
            of = {i: key for i, key in enumerate(keys) if sets[key][0] == core}
            used = sorted({c for key in of.values() for c in key})
            scores = [F.struct(F.lit(i).alias("model"), sigmoid(sum((c * float(b) for c, b in zip([F.lit(1.0), *[x for k in key for _, x in trials.terms[k].columns()]], trials.fitted(key)[1], strict=True)), F.lit(0.0))).alias("p")) for i, key in of.items()]
            cells = own.groupBy("slice", *used).agg(F.sum("_n").alias("n"), F.sum(F.col(target) * F.col("_n")).alias("y"))
            part = cells.select("slice", "n", "y", F.explode(F.array(*scores)).alias("s")).select("slice", "n", "y", "s.model", "s.p")
            long = part if long is None else long.unionByName(part)
        for r in evaluate.discrimination(long, ["model", "slice"], "n").collect():  # two rows of each model
            power[keys[r.model], r.slice] = (r.auc, r.ks)
    out = []
    for key, (name, combo) in sets.items():
        ll, beta, h = trials.fitted(key)
        cells = trials.cells(key)
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0))
        at = {c: [cells.index(i) for i in trials.places[c]] for c in key}
        p = {c: normal_tail(float(beta[i[0]] / se[i[0]])) if se[i[0]] else 1.0 for c, i in at.items() if len(i) == 1}
        base = trials.fitted(alone[name])
        base_at = {c: [trials.cells(alone[name]).index(i) for i in trials.places[c]] for c in alone[name]}
        moved = [c for c in alone[name] if any(beta[i] * base[1][j] < 0 or abs(beta[i] - base[1][j]) > shift * abs(base[1][j]) for i, j in zip(at[c], base_at[c], strict=True))]
        wrong = [t for t in combo if priors.get(t) and float(beta[at[t][0]]) * priors[t] <= 0]
        inflation = trials.inflation(key)
        worst = max(p.values(), default=0.0)
        why = "sign" if wrong else "p" if worst > rules.leave else "inflation" if rules.inflation and inflation > rules.inflation else None
        r = lambda v, d=6: None if v is None else round(float(v), d)
        auc = [power.get((key, s), (None, None)) for s in ("in", "oot")]
        out.append((name, list(combo), list(key), trials.n, int(trials.events), r(ll), r(len(cells) * math.log(max(trials.events, 2)) - 2 * ll), r(worst, 8), r(inflation), moved, wrong, *[r(v, 8) for a in auc for v in a], why))
    own.unpersist()
    trials.close()
    return rows.sparkSession.createDataFrame(out, JOINT)


def model_run(panel: DataFrame, target: str, treatments: dict[str, str], boundary: str, test_fraction: float = 0.2, account: str | None = "account_id") -> tuple[estimate.Model, DataFrame]:
    """Split by date and account, fit on the training rows, score all: the model, and the panel with p and slice."""
    late = F.col("performance_date") >= F.lit(boundary).cast("date")
    test = evaluate.split_by_account(panel, test_fraction, account=account) if account else F.lit(False)
    sliced = panel.withColumn("slice", F.when(late, "out_of_time").when(test, "test").otherwise("train"))
    model = estimate.fit_logistic(sliced.filter("slice = 'train'"), target, treatments)
    return model, sliced.withColumns({"p": model.score(), "y": F.col(target)})
