"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from riskpanel.llm import suffix_dedup as S


def brute(texts, length=S.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, seed int, n_bytes int")
    got = {r.doc_id: tuple(r)[1:] for r in S.repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = dict(enumerate(brute(texts)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(texts)


def test_planted_repeats(spark):
    r = random.Random(5)
    some = lambda n: "".join(r.choices("abcdé \n", k=n))
    passage, edge = some(400), some(230)
    texts = [some(r.randint(0, 900)) for _ in range(60)]
    texts += [some(r.randint(0, 300)) + passage[r.randint(0, 60) : r.randint(250, 400)] + some(r.randint(0, 300)) for _ in range(40)]
    texts += [edge[:199], edge, some(50) + edge[:199], some(50) + edge[1:], edge[30:] + some(9)]
    texts += [None, "", "x", texts[0], texts[0] + "y", "z" * 199, "z" * 200, "z" * 201, "z" * 1500, "zy" * 700, ("ab" * 90 + "c") * 7]
    texts += [some(120) + (p := some(300)) + some(80) + p + some(40), some(300) + p[50:290]]
    texts += [texts[3]] * 3
    check(spark, texts)


def test_frequent_seed(spark):
    """More different surroundings of one passage than a chunk holds."""
    r = random.Random(6)
    some = lambda n: "".join(r.choices("abcdefghij", k=n))
    passage = some(260)
    check(spark, [some(150) + passage + some(150) for _ in range(S.CHUNK + 200)] + [some(400)])


def test_long_text_and_places():
    r = np.random.default_rng(1)
    h = r.integers(0, 50, 3000).astype(np.uint64) << np.uint64(40)
    best = S.least_places(h, 169)
    for i in range(0, len(best), 37):
        own = h[i : i + 169]
        assert best[i] == i + max(np.flatnonzero(own == own.min()))
    h = S.mixed(np.arange(2**21 + 5000, dtype=np.uint64))
    h = h >> np.uint64(S.PLACE_BITS) << np.uint64(S.PLACE_BITS)
    best = S.least_places(h, 169)
    assert len(best) == len(h) - 168
    for i in [*range(2**21 - 400, 2**21 + 100, 7), len(best) - 1, 0]:
        assert h[best[i]] == h[i : i + 169].min() and i <= best[i] < i + 169


def test_rolled_is_by_content():
    data = np.frombuffer(b"abcabcabcabc" * 40, np.uint8)
    got = S.rolled(data, 200)
    assert len(got) == len(data) - 199 and len(set(got.tolist())) == 3 and got[0] == got[3]


def test_index_over_runs(spark, tmp_path):
    """A stored index is opened again: new texts lose what also starts in earlier ones, and levels merge as in binary counting."""
    r = random.Random(8)
    some = lambda n: "".join(r.choices("abcdefgh \n", k=n))
    shared = [some(300) for _ in range(6)]
    runs = [[some(100) + r.choice(shared) + some(100) for _ in range(4)] + [some(500), None, ""] for _ in range(4)]
    runs[3].append(runs[0][0])
    path, seen, levels = str(tmp_path / "index"), [], []
    for run in runs:
        df = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {x.doc_id: tuple(x)[1:] for x in S.repeated_bytes(df(run), batches=1, index=path, known=df(seen)).collect()}
        assert got == dict(enumerate(brute(seen + run)[len(seen) :]))
        seen += run
        levels.append(S.Family(spark, path).levels)
    assert levels == [[(0, 1)], [(0, 2)], [(0, 2), (2, 3)], [(0, 4)]]
    family = S.Family(spark, path)
    entries = [x.suffix for x in family.level(0, 4).collect()]
    assert len(set(entries)) == len(entries)
    # A level is in order over all its files, and a level that another one covers is left aside.
    ranges = sorted((x.lo, x.hi) for x in family.level(0, 4).groupBy(S.F.input_file_name()).agg(S.F.min("suffix").alias("lo"), S.F.max("suffix").alias("hi")).collect())
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    family.write(family.level(0, 4), 2, 4)
    assert S.Family(spark, path).levels == [(0, 4)]


def test_empty_table(spark):
    assert S.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_surroundings_without_a_common_window_give_no_runs():
    r = np.random.default_rng(12)
    around = [r.integers(0, 256, 260, dtype=np.uint8).tobytes() for _ in range(2)]
    rows = pd.DataFrame({"seed": [1, 1], "digest": [5, 6], "windows": [61, 61], "around": around})
    (out,) = S.matched_runs(iter([rows]))
    assert not len(out) and out["runs"].dtype == object
    rows["around"] = [around[0]] * 2
    (out,) = S.matched_runs(iter([rows]))
    assert [x.tolist() for x in out["runs"]] == [[0, 60]] * 2
