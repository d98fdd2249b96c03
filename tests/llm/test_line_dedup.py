"""Near-equal lines against comparing all pairs of lines."""

import random

import pytest

from riskpanel.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs):
    """(id, text) rows to {row: (n_lines, n_equal, n_near)} for different (id, text)."""
    lines = []
    for key in {(d, t or "") for d, t in docs}:
        for i, line in enumerate(key[1].lower().split("\n")):
            if words := tuple(line.encode().split()):
                lines.append((key, i, words))
    first = {}
    order = lambda x: (x[0][0] is None, x[0][0] or 0, hash_of(x[0][1]), x[1])
    for x in sorted(lines, key=order):
        first.setdefault(x[2], x)
    near = {w for w, x in first.items() for v, y in first.items() if len(w) >= 5 and len(v) >= 5 and order(y) < order(x) and abs(len(w) - len(v)) <= 1 and distance(w, v) <= 1}
    out = {}
    for key in {(d, t or "") for d, t in docs}:
        own = [x for x in lines if x[0] == key]
        out[key] = (len(own), sum(first[x[2]] != x for x in own), sum(first[x[2]] == x and x[2] in near for x in own))
    return out


def hash_of(text):
    return 0  # ids in these tests are unique, so the tie-break by text doesn't matter


def test_matches_all_pairs(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(4, 9))] for _ in range(12)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            words = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(words))
                kind = r.randrange(3)
                words[at : at + (kind != 0)] = [r.choice([*vocabulary, "New"])] if kind < 2 else []
            lines.append(" ".join(words))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "  \n\n \t"), (None, "w1 w2 w3 w4 w5 w1\nx y"), (103, docs[0][1])]
    want = brute(docs)
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in [*docs, docs[5]]], "doc_id long, text string, line int, first string")
    found = line_dedup.line_duplicates(df).collect()
    assert len(found) == len(docs) + 1
    texts = dict(docs)
    for row in found:
        assert (row.n_lines, row.n_equal, row.n_near) == want[row.doc_id, texts[row.doc_id] or ""]
    assert any(row.n_near for row in found)


def test_cleaned_texts(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon\nkeep me\n"), (2, "intro line\nalpha beta gamma delta zeta\nalpha  BETA gamma delta epsilon"), (3, None)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.clean_documents(df).collect()}
    assert kept == {1: "Alpha beta gamma delta epsilon\nkeep me\n", 2: "intro line", 3: None}


def test_long_lines_empty_tables_and_large_groups(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, long), (2, long.replace("t15000 ", "")), (3, long.replace("t7 ", "x "))]
    rows += [(10 + i, f"this is chapter number {i} of the whole book") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.n_near for r in line_dedup.line_duplicates(df).collect()}
    assert found[1] == 0 and found[2] == found[3] == 1
    assert found[10] == 0 and all(found[i] == 1 for i in range(11, 510))
    assert line_dedup.line_duplicates(df.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("n", range(5, 60))
def test_halves_leave_room_for_one_word(n):
    assert 0 < line_dedup.half_of(n) <= (n - 1) // 2


def test_edit_bound():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("xyz") for _ in range(r.randint(0, 6))] for _ in range(2))
        for bound in (1, 2):
            assert line_dedup.within_edits(a, b, bound) == (distance(a, b) <= bound)
