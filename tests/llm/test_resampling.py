"""Importance resampling against its definition."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import resampling as R

KIND = "doc_id long, text string, score int, weight string, _id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    own = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return own, [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]


def plain(rows, target, most=1, buckets=10_000, percent=10):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text, most)[1]:
                counts[at(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        words, own = features(text, most)
        weight = sum(gain[at(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def check(spark, rows, target, **how):
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], KIND).repartition(5)
    got = R.resample(docs, spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int"), **how).collect()
    names = {"most", "buckets", "percent"}
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, target, **{k: v for k, v in how.items() if k in names}), key=str)
    return got


def some(r, n):
    return "".join(r.choice(["a", "B", "é", "7", "word", "Word", " ", "  ", "\n", "-", "_", "\x00", "\x7f", "語", "[", "`", "{", "İ", " "]) + r.choice(["", " "]) for _ in range(n))


@pytest.mark.parametrize("how", [{}, {"most": 3, "buckets": 50}, {"percent": 73, "buckets": 7}])
def test_against_definition(spark, how):
    r = random.Random(1)
    rows = [(i * (-1) ** i * 10 ** r.randint(0, 12), some(r, r.choice([0, 3, 40, 60, 400]))) for i in range(400)]
    rows += [(5, None), (6, ""), (None, rows[3][1]), (7, "x " * 100_000)]
    check(spark, rows, [some(r, 50) for _ in range(20)] + [None], **how)


def test_copies_ties_and_hot_ids(spark):
    r = random.Random(2)
    long = some(r, 90)
    rows = [(9, long)] * 150 + [(None, long)] * 90 + [(i, long) for i in range(60)] + [(i, some(r, 70)) for i in range(100)]
    for percent in (1, 35, 50, 100):
        check(spark, rows, [long], percent=percent)


def test_copies_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "COPIES", 16)
    rows = [(9, "a b " * 30)] * 150 + [(i, "c d " * 15) for i in range(50)]
    check(spark, rows, [], percent=60)


def test_empty_tables(spark):
    assert check(spark, [], ["a"]) == []
    check(spark, [(1, "a " * 30), (2, "b " * 30)], [])
    check(spark, [(1, "a " * 30), (2, None)], ["a"], percent=100)


def test_words_come_in_pieces(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(R, "PIECE", 5)
    for _ in range(200):
        text = some(r, r.randint(0, 30))
        own, want = features(text, 3)
        assert [w.decode() for piece in R.words(text.encode()) for w in piece] == own
        assert sorted(x.decode() for x in R.runs(R.words(text.encode()), 3)) == sorted(want)


def test_kth_key(spark):
    r = random.Random(4)
    values = [r.choice([0, -1, 2**63 - 1, -(2**63), r.randint(-(2**63), 2**63 - 1), r.randint(0, 9)]) for _ in range(500)] + [None] * 20
    rows = spark.createDataFrame([(v, r.randint(0, 1)) for v in values], "a long, b int").cache()
    keyed = rows.withColumns(dict(zip(["x", "y"], R.key([(F.col("b"), True), (F.col("a"), False)]), strict=True)))
    order = sorted(((0, -b), (int(a is None), a or 0)) for a, b in (tuple(x) for x in rows.collect()))
    for k in (1, 7, 250, 251, 500, 519, 520):
        assert tuple(R.kth(keyed, ["x", "y"], k)) == order[k - 1]
