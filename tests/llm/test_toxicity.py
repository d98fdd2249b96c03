"""The network's gradients, and its accuracy on held-out rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskpanel.llm import toxicity as T


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = T.Network({"bad": 2.0, "good": -1.0, "x": 0.1}, {"<bad": 2.0, "bad>": 1.0, "good": -1.0}, 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = ["bad", "good", "other", "x", "badly"]
    items = net.items(words)
    windows = r.integers(0, 5, (4, 7))
    windows[1, 3:] = -1
    y = np.array([1, 0, 1, 0])
    drop = np.zeros(5, bool)
    _, g = net.gradients(items, windows, y, drop)
    for k, v in net.p.items():
        for at in [tuple(r.integers(0, s) for s in v.shape) for _ in range(6)]:
            if k in ("ew", "ec") and at[0] == 0:
                continue
            old, losses = v[at], []
            for e in (1e-3, -1e-3):
                v[at] = old + e
                losses.append(net.gradients(items, windows, y, drop)[0])
            v[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 2e-4, (k, at)


def test_windows_cover_all_words():
    for n in (1, 31, 64, 65, 96, 97, 500):
        w = T.windows_of(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == T.WINDOW
        assert len(w) == 1 or (w[-1] >= 0).sum() > T.WINDOW - T.STEP


def test_held_out_accuracy(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 6)))
    rows, labels = [], []
    for i in range(700):
        w = [word() for _ in range(r.randint(5, 300))]
        if toxic := i % 4 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["zork", "vumpl"]) + r.choice(["", word()]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(toxic)))
    rows += [(800, None, "a"), (801, "", "a"), (802, " ..", "a"), (0, rows[0][1], "a"), (None, "words", "a")]
    labels += [(None, 1, 1), (1, 1, None), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = T.toxicity(docs, known).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out if x.doc_id is not None)
    held = [i for i in range(700) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert [got[i].score for i in (800, 801, 802)] == [0, 0, 0]
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)


def test_nothing_to_learn_or_score(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(x)[2:] for x in T.toxicity(docs, none).collect()] == [(0.0, 0)]
    assert T.toxicity(docs.limit(0), none).count() == 0


def test_training_repeats():
    texts = ["bad thing here", "fine thing here", "bad bad", "fine words"] * 5
    y = np.array([1, 0, 1, 0] * 5)
    a, b = (T.train(texts, y, 2) for _ in range(2))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_scores_match_a_network_that_is_read_step_by_step():
    """Each window word by word with plain loops, from both ends, then attention; the highest window counts."""
    r = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(60)]
    texts = [" ".join(r.choice(vocabulary, n)) + (" bad" if n % 2 else "") for n in (1, 3, 40, 63, 64, 65, 95, 97, 200, 330)]
    net = T.train(texts * 3, np.array([int("bad" in t) for t in texts * 3]), 2)
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, p = T.HIDDEN, {k: v.astype(float) for k, v in net.p.items()}

    def read(xs, d):
        h, out = np.zeros(n), []
        for x in xs:
            a, u = x @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            z, gate = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(a[2 * n :] + gate * u[2 * n :])
            h = new + z * (h - new)
            out.append(h)
        return out

    def window(words):
        xs = [row.astype(float) for row in net.input_rows(net.items(words))]
        states = [np.concatenate(s) for s in zip(read(xs, "f"), read(xs[::-1], "b")[::-1], strict=True)]
        weight = np.exp([s @ p["v"] for s in states])
        return sig(sum(w * s for w, s in zip(weight, states, strict=True)) / weight.sum() @ p["o"] + p["k"][0])

    for text, found in zip(texts, net.scores(texts), strict=True):
        words = T.words_of(text)
        starts = range(0, max(1, len(words) - T.WINDOW + T.STEP), T.STEP) if len(words) > T.WINDOW else [0]
        assert abs(found - max(window(words[s : s + T.WINDOW]) for s in starts)) < 1e-4


def test_sample_is_of_labels_that_documents_have(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = spark.createDataFrame([(i * 97, f"text {i}") for i in range(200)], "doc_id long, text string")
    texts, y = T.sample(docs, labels, "doc_id", "text", "toxic", 150, 1000)
    want = [i for i in range(200) if zlib.crc32(str(i * 97).encode()) % 5]
    assert sorted(texts) == sorted(f"text {i}" for i in want) and len(y) == len(want)
