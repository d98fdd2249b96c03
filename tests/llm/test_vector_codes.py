"""Vector codes against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest

from riskpanel.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int, code string, _id int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same by its definition: rows of (vec_id, vector, label), in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(np.float32(c) * 4096.0)) for c in r[1]] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in own[:entries]] for own in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in cut[p]:
                held.setdefault(nearest(v, books[p])[1], []).append(v)
            for e, own in held.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(x))]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{e:02x}" for _, e in f), d, by[r[2]], digest) for r, f, d in zip(rows, found, errors, strict=True))


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], KIND)
    out = V.compress(df).collect()
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


def test_against_plain_arithmetic(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), r.normal(0, 0.2, 16).astype(np.float32).tolist(), int(r.integers(3)) if r.random() < 0.8 else None) for i in r.permutation(300)]
    rows += [(7, rows[5][1], 1), (None, rows[6][1], None), (400, [0.0] * 16, 2), (401, [0.0] * 16, 2)] + [(500 + i, rows[0][1], 1) for i in range(150)]
    rows += [(900, None, 1), (901, [None] + [0.1] * 15, 1), (902, [float("nan")] + [0.1] * 15, 1), (903, [float("inf")] + [0.1] * 15, 1), (904, [0.5] * 8, 1), (905, [], 1)]
    want = plain([x for x in rows if x[0] not in (904, 905)])
    assert got(spark, rows) == want


def test_few_rows_and_ties(spark):
    # On a grid of few points almost all distances are tied.
    r = np.random.default_rng(4)
    rows = [(i, (r.integers(-1, 2, 8) / 4096).tolist(), 0) for i in range(40)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:3]) == plain(rows[:3])
    assert got(spark, []) == []


def test_lengths_that_parts_do_not_divide(spark):
    rows = [(i, [float(i), 1.0, 2.0], 0) for i in range(20)]
    out = got(spark, rows)
    assert len(out) == 20 and all(len(x[2]) == 16 and x[2].endswith("00" * 5) for x in out)
    assert [s.stop - s.start for s in V.cuts(11)] == [2, 2, 2, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("size", [3, 40, 4000, 1 << 26])
def test_screen_is_exact(size):
    r = np.random.default_rng(size)
    x, c = r.integers(-size, size + 1, (3000, 8)), r.integers(-size, size + 1, (16, 8))
    x[:400] = (c[r.integers(0, 16, 400)] + c[r.integers(0, 16, 400)]) // 2  # as far from two entries, or nearly so
    c[9] = c[4]
    best, distance = V.nearest(x, c)
    want = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (best == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_huge_components_are_held_within_the_limit(spark):
    rows = [(i, [3e38 if i == 5 else float(i)] * 8, 0) for i in range(30)]
    out = V.compress(spark.createDataFrame([(*r, "x", 3) for r in rows], KIND)).collect()
    assert len(out) == 30 and all(r.error >= 0 for r in out)
    assert 4 * V.limit(64) ** 2 * 64 < 2**63 and V.limit(64) == 1 << 27
