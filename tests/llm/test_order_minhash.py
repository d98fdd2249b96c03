"""Order MinHash near-dedup against brute force on small texts."""

import random
from collections import defaultdict

import numpy as np
import regex

from riskpanel.llm import order_minhash as M


def labelled(text):
    w = [x for x in regex.findall(r"[^\W_]+", (text or "").lower())]
    w += ["\0"] * (5 - len(w)) if w else []
    seen, out = defaultdict(int), []
    for i in range(len(w) - 4):
        k = tuple(w[i : i + 5])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(texts):
    """Classes of (id, text) by links at 0.8 of the ordered Jaccard similarity."""
    root = {i: i for i, _ in texts}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    own = [(i, labelled(t)) for i, t in texts]
    for p, (i, a) in enumerate(own):
        for j, b in own[:p]:
            if a and b and len(set(a) & set(b)) >= 0.4 * max(len(a), len(b)):
                m = lcs(a, b)
                if m >= 0.8 * (len(a) + len(b) - m) - 1e-9:
                    u, v = sorted((find(i), find(j)))
                    root[v] = u
    return {i: find(i) for i in root}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(r.randint(12, 90))] for _ in range(14)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.randint(0, 5)):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(c))
                c[at : at + 1] = r.choice([[], [word()], [c[at], word()]])
            texts.append(" ".join(c))
        texts.append(" ".join(b[len(b) // 2 :] + b[: len(b) // 2]))
        texts.append(" ".join(passage + [word() for _ in range(60)]))
    return [(i, t) for i, t in enumerate(texts)]


def test_classes_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [(900, None), (901, ""), (902, "  ..,"), (903, "one two"), (904, "One, two!"), (905, "one two three"), (3, rows[3][1])]
        rows += [(906, "same words here " * 3000), (907, "same words here " * 3000 + "end")]
        df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, node string, n int")
        out = M.near_duplicates(df).collect()
        want = brute([x for x in dict(rows).items() if x[0] < 906])
        want |= {906: 906, 907: 906}
        assert {r.doc_id: r.class_id for r in out} == want and len(out) == len(rows)
        assert {r.doc_id: r.n_class for r in out}[900] == 1


def test_group_of_many_near_copies(spark):
    """More members than a block holds, of which leaders don't connect all."""
    r = random.Random(3)
    base = [f"w{j}" for j in range(80)]
    rows = []
    for i in range(700):
        c = list(base)
        for _ in range(r.randint(0, 2)):
            c[r.randrange(80)] = f"x{i}y{r.random()}"
        rows.append((i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in M.near_duplicates(df).collect()}
    sets = [set(labelled(t)) for _, t in rows]
    root = list(range(700))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(700):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    assert got == {i: find(i) for i in range(700)}


def test_pieces():
    assert M.longest_increasing(np.array([3, 1, 2, 9, 4, 5, 0])) == 4
    a = M.kmers("a b c d e f g h i j".split())
    assert len(a) == 6 and M.aligned(a, a) == 1.0 and M.aligned(a, a[::-1]) == 0.0
    assert len(set(M.kmers(["x"] * 500).tolist())) == 496


def test_empty_table_and_filter(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert M.near_duplicates(df).count() == 0
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c, d e f g h."), (3, None), (4, None), (5, "other words in this text are alone")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    left = M.filter_documents(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5]
