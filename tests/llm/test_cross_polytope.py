"""Nearest neighbours by cross-polytope hashing against all inner products."""

import numpy as np
import pytest

from riskpanel.llm import cross_polytope as C

KIND = "vec_id long, embedding array<float>, label int, k1 string, v int, id long"


def plain(rows, every=20, nearest=20):
    """query, rank, id and score of all pairs; rows of (vec_id, vector) once each."""
    rows = list({(i, tuple(v)): (i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}.values())
    x = np.array([v for _, v in rows])
    last = np.array([2**63 - 1 if i is None else i for i, _ in rows])
    out = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            score = np.zeros(len(x))
            for k in range(x.shape[1]):
                score += v[k] * x[:, k]
            order = [m for m in np.lexsort((last, -score)) if m != n][:nearest]
            out[(i, tuple(v))] = [(rows[m][0], float(score[m])) for m in order]
    return out


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], KIND).repartition(4)
    return C.neighbours(df, **how).orderBy("query_id", "rank").collect()


def vectors(r, n, d=24):
    x = r.normal(0, 1, (n, d)) + 2 * r.normal(0, 1, (12, d))[r.integers(0, 12, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(rows, want):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i, _ in want}
    hit = 0
    for (i, _), near in want.items():
        own = sorted(found[i])
        assert [k for k, _, _ in own] == list(range(1, len(near) + 1))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hit += len({v for _, v, _ in own} & {v for v, _ in near})
    return hit / sum(len(n) for n in want.values())


def test_recall_and_scores(spark):
    x = vectors(np.random.default_rng(1), 6000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = got(spark, rows)
    assert recall(out, plain(rows)) >= 0.9
    for r in out[:200]:
        assert r.score == C.products(x[[r.query_id]].astype(np.float64), x[[r.vec_id]].astype(np.float64))[0]


def test_recall_of_vectors_of_any_length(spark):
    r = np.random.default_rng(2)
    x = vectors(r, 5000) * np.exp(r.normal(0, 1.5, (5000, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(got(spark, rows), plain(rows)) >= 0.9


def test_small_tables_are_searched_whole(spark):
    # With all cells searched nothing is missed: copies, ties, null ids, ids with several vectors, and rows that take no part.
    r = np.random.default_rng(3)
    x = vectors(r, 60, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(90)] * 2 + [(None, x[1].tolist()), (3, x[2].tolist()), (20, x[5].tolist())]
    rows += [(200, None), (220, [0.0] * 8), (240, [None] + [1.0] * 7), (260, [float("nan")] * 8), (280, [float("inf")] * 8), (300, []), (320, [1.0] * 5)]
    want = plain([r for r in rows if r[0] not in (320,)])
    have = {}
    for r in got(spark, rows, target=1.0):
        have.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    by_id = {}
    for (i, _), near in want.items():
        by_id.setdefault(i, []).extend((k + 1, v, s) for k, (v, s) in enumerate(near))
    order = lambda t: (t[0], t[1] is None, t[1] or 0, t[2])
    assert {i: sorted(v, key=order) for i, v in have.items()} == {i: sorted(v, key=order) for i, v in by_id.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_few_rows(spark, n):
    rows = [(20 * i, v.tolist()) for i, v in enumerate(vectors(np.random.default_rng(4), n, 5))]
    out = got(spark, rows)
    assert len(out) == n * max(0, n - 1) and {(r.query_id, r["rank"], r.vec_id) for r in out} == {(i, k + 1, v) for (i, _), near in plain(rows).items() for k, (v, _) in enumerate(near)}


def test_cut_cells_and_queries_that_find_too_little(spark, monkeypatch):
    r = np.random.default_rng(5)
    near = vectors(r, 1, 16) + r.normal(0, 0.003, (3000, 16)).astype(np.float32)  # one cell holds almost all
    x = np.concatenate([near, vectors(r, 300, 16)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(C, "BLOCK", 256)
    monkeypatch.setattr(C, "fitted", lambda *a: (9, 1, 1))
    out = got(spark, rows)
    assert len(out) == 20 * 165  # each query has 20, though its one cell may hold fewer
    found = {}
    for o in out:
        found.setdefault(o.query_id, set()).add(o.vec_id)
    want = {i: {v for v, _ in near} for (i, _), near in plain(rows).items()}
    assert np.mean([len(found[i] & want[i]) / 20 for i in want if i < 3000]) > 0.9


def test_digits_and_cells():
    assert C.bit_deal(8, 128) == [8] and C.bit_deal(9, 128) == [5, 4] and C.bit_deal(17, 128) == [6, 6, 5]
    x = C.lifted(vectors(np.random.default_rng(6), 50, 16))
    assert x.shape[1] == 32 and np.allclose(np.linalg.norm(C.hadamard(x), axis=1), 1, atol=1e-5)
    for bits in (1, 4, 6, 9, 11):
        assert (C.cells(x, 2, bits, 1)[:, 0] == C.cell(x, 2, bits)).all()
        every = C.cells(x, 2, bits, 1 << bits)
        assert (np.sort(every, axis=1) == np.arange(1 << bits)).all()
        assert (C.cells(x, 2, bits, 1 << bits)[:, :3] == C.cells(x, 2, bits, 3)).all()
