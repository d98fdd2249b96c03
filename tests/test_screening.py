"""Exact frames, optimal bins, null floors and loan-level rank correlation against plain computations."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskpanel.functions.exprs import student_tail
from riskpanel.operators import frames, macro_severity, null_floors
from riskpanel.operators import optimal_binning as ob


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frame_is_the_same_under_any_partitioning(spark):
    df = spark.range(20_000).select(F.col("id").alias("account"), (F.col("id") % 41 == 0).cast("int").alias("y"), (F.col("id") % 7).alias("x"))
    found = [frames.event_frame(d, "y", 3000, ["account"]) for d in (df, df.repartition(7), df.repartitionByRange(3, F.desc("account")))]
    first = rows_of(found[0].rows)
    assert all(rows_of(f.rows) == first for f in found) and all(f.thinned for f in found)
    events = df.filter("y = 1").count()
    assert len(first) == 3000 and sum(r[1] for r in first) == events
    assert found[0].kept_share == (3000 - events) / (20_000 - events)
    # The rows of least hash.
    import hashlib

    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    want = sorted((i for i in range(20_000) if i % 41), key=h)[: 3000 - events]
    assert {r[0] for r in first if not r[1]} == set(want)


def test_frame_of_repeated_rows_nulls_and_small_tables(spark):
    df = spark.createDataFrame([(1, 0)] * 500 + [(2, 1)] * 40 + [(3, None)] * 300 + [(None, 0)] * 200, "a int, y int")
    out = frames.event_frame(df, "y", 640, least_others=100)
    assert out.rows.count() == 640 and out.rows.filter("y = 1").count() == 40
    assert frames.event_frame(df, "y", 10, least_others=100).rows.count() == 140
    assert not frames.event_frame(df, "y", 1040).thinned
    assert frames.event_frame(df.limit(0), "y", 5).rows.count() == 0


def test_cut_hash_reads_ranges(spark, monkeypatch):
    monkeypatch.setattr(frames, "READ", 3)
    r = np.random.default_rng(1)
    h = [int(x) for x in r.integers(0, 1 << 60, 300)] + [5] * 40 + [(1 << 60) - 1] * 3
    df = spark.createDataFrame([(x,) for x in h], "h long")
    for n in (1, 17, 40, 41, 200, 340, 343):
        cut = sorted(h)[n - 1]
        assert frames.cut_hash(df, n) == (cut, n - sum(x < cut for x in h))


def plain_best(n, e, most, floor, trend):
    """All merges."""
    best, p = (-np.inf, None), len(n)
    ups = lambda r: all(b >= a for a, b in zip(r, r[1:], strict=False))
    downs = lambda r: all(b <= a for a, b in zip(r, r[1:], strict=False))
    turn = lambda r, f, g: any(f(r[: i + 1]) and g(r[i:]) for i in range(len(r)))
    ok = {"ascending": ups, "descending": downs, "auto": lambda r: ups(r) or downs(r), "any": lambda r: True, "peak": lambda r: turn(r, ups, downs), "valley": lambda r: turn(r, downs, ups)}[trend]
    for k in range(most):
        for cut in combinations(range(1, p), k):
            starts = [0, *cut]
            a, b = np.add.reduceat(n, starts), np.add.reduceat(e, starts)
            if (a >= floor).all() and ok(list(b / a)):
                iv = ob.segment_information(a, b, e.sum(), n.sum() - e.sum()).sum()
                if iv > best[0] + 1e-12:
                    best = (iv, starts)
    return best


@pytest.mark.parametrize("trend", ob.TRENDS)
def test_optimal_bins_against_all_merges(trend):
    r = np.random.default_rng(len(trend))
    for _ in range(25):
        p = int(r.integers(1, 11))
        n = r.integers(1, 300, p).astype(float)
        e = np.floor(n * np.clip(r.beta(1, 6, p) + r.choice([0, 0.05]) * np.arange(p), 0, 1))
        share = float(r.choice([0.0, 0.05, 0.2]))
        want = plain_best(n, e, 5, max(30, share * n.sum()), trend)
        starts, iv, _ = ob.merged(n, e, 5, 1, share, 30, trend)
        if want[1] is None:
            assert starts == [0]
        else:
            assert abs(iv - want[0]) < 1e-9 and starts[0] == 0
            a, b = np.add.reduceat(n, starts), np.add.reduceat(e, starts)
            assert abs(ob.segment_information(a, b, e.sum(), n.sum() - e.sum()).sum() - iv) < 1e-9 and len(starts) <= 5


def test_wished_number_of_bins():
    n, e = np.full(10, 100.0), np.array([1, 2, 3, 5, 8, 12, 20, 30, 40, 60.0])
    assert len(ob.merged(n, e, 6, 6)[0]) == 6
    zigzag = np.array([10, 2, 10, 2, 10, 2, 10, 2, 10, 2.0])
    assert len(ob.merged(n, zigzag, 8, 8, trend="ascending")[0]) < 8  # a trend that can't have so many has fewer
    with pytest.raises(ValueError):
        ob.merged(n, e, trend="up")


def test_floor_is_that_of_real_permutations(spark):
    r = np.random.default_rng(3)
    n = [400, 700, 300, 900, 200, 500]
    cells = np.repeat(np.arange(6), n)
    y = (r.random(len(cells)) < 0.06).astype(int)
    counts = spark.createDataFrame([("a", int(b), int((cells == b).sum()), int(y[cells == b].sum())) for b in range(6)], "name string, bin int, n long, events long")
    own = null_floors.permutation_floor(counts, 200).first()
    ivs = []
    for _ in range(200):
        z = r.permutation(y)
        ivs.append(ob.merged([(cells == b).sum() for b in range(6)], [z[cells == b].sum() for b in range(6)], trend="any")[1])
    assert abs(own.mean_iv - np.mean(ivs)) < 4 * np.hypot(own.mean_error, np.std(ivs) / 200**0.5)
    assert null_floors.permutation_floor(counts.repartition(3), 200).first() == own
    assert own.floor == pytest.approx(own.mean_iv + 2 * own.sd_iv)
    plain = null_floors.permutation_floor(counts, 200, rebinned=False).first()
    assert 0 < plain.mean_iv < 5 * own.mean_iv


def test_draws_of_events():
    rng = np.random.default_rng(4)
    found = np.array([null_floors.permuted(rng, [50, 0, 30, 20], 40) for _ in range(3000)])
    assert (found.sum(axis=1) == 40).all() and (found <= [50, 0, 30, 20]).all()
    assert np.allclose(found.mean(axis=0), [20, 0, 12, 8], atol=0.3)
    assert found[:, 0].std() == pytest.approx((40 * 0.5 * 0.5 * 60 / 99) ** 0.5, rel=0.1)
    big = [null_floors.hypergeometric(rng, 3 * 10**9, 6 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 10**6 / 3) < 200


def test_tail_of_students_t(spark):
    known = [(2.085963, 20.0, 0.05), (4.302653, 2.0, 0.05), (2.660283, 60.0, 0.01), (0.0, 7.0, 1.0), (-1.475884, 5.0, 0.2)]
    rows = spark.createDataFrame(known, "t double, df double, p double").select(student_tail(F.col("t"), F.col("df")).alias("got"), "p").collect()
    assert all(abs(r.got - r.p) < 2e-6 for r in rows)


def test_rank_correlation_of_loans(spark):
    r = np.random.default_rng(5)
    months = pd.date_range("2000-01-01", periods=40, freq="MS")
    panel = [(m.date(), 1, float(np.round(np.clip(r.normal(0.4 + 0.005 * i, 0.3), -0.2, 1.2), 2))) for i, m in enumerate(months) for _ in range(int(r.integers(0, 9)))]
    panel += [(months[3].date(), 0, 0.5), (months[4].date(), 1, None)]
    df = spark.createDataFrame(panel, "performance_date date, default_flag int, lgd_realised double")
    walk = np.cumsum(r.normal(0, 1, 40))
    terms = {"whole": walk, "late": np.where(np.arange(40) < 12, np.nan, np.round(walk)), "flat": np.ones(40), "short": np.where(np.arange(40) < 37, np.nan, walk)}
    long = [(k, m.date(), None if np.isnan(v) else float(v)) for k, x in terms.items() for m, v in zip(months, x, strict=True)]
    got = {x.candidate: x for x in macro_severity.rank_correlations(spark.createDataFrame(long, "candidate string, month date, value double"), macro_severity.severity_counts(df, "default_flag")).collect()}
    seen = pd.DataFrame([p for p in panel if p[1] and p[2] is not None], columns=["month", "y", "s"])
    for name, x in terms.items():
        d = seen.assign(x=seen["month"].map(dict(zip((m.date() for m in months), x, strict=True))), s=seen["s"].clip(0, 1)).dropna()
        own = got[name]
        assert own.n == len(d) and own.months == d["month"].nunique()
        if name in ("flat", "short"):
            assert own.r is None and own.p is None
            continue
        assert own.r == pytest.approx(d["x"].rank().corr(d["s"].rank()), abs=1e-9)
        m = d.groupby("month")["x"].first().to_numpy()
        a = m - m.mean()
        rho = min(0.99, (a[:-1] @ a[1:] / (a @ a)) ** 2)
        assert own.n_effective == pytest.approx(min(len(m), max(4, len(m) * (1 - rho) / (1 + rho))))
        assert own.t == pytest.approx(own.r * ((own.n_effective - 2) / (1 - own.r**2)) ** 0.5) and 0 <= own.p <= 1


def test_frame_reads_its_input_once_before_it_is_taken(spark):
    """Only the frame's own rows read the input again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    df = spark.range(5000).selectExpr("id AS account", "int(id % 50 = 0) AS y").mapInPandas(counted, "account long, y int")
    out = frames.event_frame(df, "y", lambda n: n // 5, ["account"], 100)
    assert seen.value == 5000
    rows = out.rows.collect()
    assert seen.value == 10_000 and len(rows) == 1000 and sum(r.y for r in rows) == 100 and out.kept_share == 900 / 4900


def test_rank_correlations_with_holes_shuffle_no_pairs(spark):
    from riskpanel.operators import binning

    r = np.random.default_rng(3)
    t = pd.DataFrame({"a": r.integers(0, 9, 3000).astype(float), "b": r.normal(size=3000).round(1), "c": r.integers(0, 4, 3000).astype(float), "one": 1.0})
    t["b"] += t["a"] / 5
    t.loc[r.random(3000) < 0.2, "a"] = np.nan
    t.loc[r.random(3000) < 0.1, "c"] = np.nan
    df = spark.createDataFrame(t).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in t])
    out = binning.rank_correlations(df, list(t))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    found = {(x.a, x.b): (x.n, x.r) for x in out.collect()}
    for x, y in combinations(t, 2):
        own = t[[x, y]].dropna().rank()
        want = None if "one" in (x, y) else round(own[x].corr(own[y]), 7)
        assert found[x, y][0] == len(own) and found[x, y][1] == (want if want is None else pytest.approx(want, abs=1.1e-7))
    assert plan[: plan.index("InMemoryRelation")].count("Generate explode") == 1 and "Aggregate [one#" not in plan


def test_stability_counts_base_values_only(spark):
    """What is kept by value are base rows; other rows are kept by bin."""
    from riskpanel.operators import binning

    df = spark.range(6000).selectExpr("add_months(DATE'2010-01-01', int(id % 48)) AS performance_date", "id * 7919 % 6007 / 3.0 AS v")
    out = binning.psi_over_time(df, ["v"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 16 and "value#" in plan and not [line for line in plan.split("\n") if "Aggregate [name#" in line and "value#" in line.split("], [")[0] and "period#" in line.split("], [")[0]]
