"""Mixing, sharding, chat formatting, decontamination: small cases against brute force."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import chat_format, decontaminate, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rank long, _h1 string, slot string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with other columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 5, "x", "y") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 5}, {"a": 97, "b": 1, "c": 31}, {x: 1 for x in "abcdefg"}])
def test_edf_holds_every_share(weights):
    slots, period = mixing.edf_period(weights), sum(weights.values())
    assert sorted(t for x in slots.values() for t in x) == list(range(period))
    for s, a in weights.items():
        assert len(slots[s]) == a
        for j, t in enumerate(slots[s]):
            assert j * period // a <= t < -(-(j + 1) * period // a)


def test_mix_places_every_row_once(spark):
    rows = [(i, "t", None if i % 7 == 0 else "hot" if i % 2 else f"s{i % 5}") for i in range(997)] + [(1, "t", "hot")]
    out = mixing.mix(docs(spark, rows), {"hot": 3, None: 1, "s0": 2, "s2": 2, "s4": 1}, block_rows=8).collect()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in rows)
    blocks = defaultdict(set)
    for r in out:
        blocks[r.slot].add((r.source, r.block))
        assert r.release <= r.slot < r.deadline
    assert sorted(blocks) == list(range(len(blocks))) and all(len(x) == 1 for x in blocks.values())
    # within the first phase each source's share deviates by less than one block
    w = {"hot": 3, None: 1, "s0": 2, "s2": 2, "s4": 1}
    w = {s: w[s] for s in {r.source for r in out if r.phase == 0}}
    end = max(r.slot for r in out if r.phase == 0) + 1
    done = Counter()
    order = {slot: next(iter(x))[0] for slot, x in blocks.items()}
    if sum(w.values()) == 9:
        for t in range(end):
            done[order[t]] += 1
            assert all(abs(done[s] - (t + 1) * a / 9) < 1 for s, a in w.items())
    by_position = sorted(out, key=lambda r: r.position)
    assert [r.slot for r in by_position] == sorted(r.slot for r in out)


def test_mix_empty_and_documents(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(100)]
    out = mixing.mixed_documents(docs(spark, rows), block_rows=4)
    assert out.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(100))
    placed = sorted((r.position, r.source) for r in mixing.mix(docs(spark, rows), block_rows=4).collect())
    assert [r.source for r in out.collect()] == [s for _, s in placed]


def test_mix_refuses_too_many(spark):
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, [(1, "", "a")]), {"a": mixing.MAX_PERIOD + 1})


@pytest.mark.parametrize("rows", [
    [],
    [(1, "x", "a")],
    [(i, f"t{i}", "a") for i in range(41)],
    [(i, "same" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"own {i}", "a") for i in range(400)] + [(7, None, "a"), (8, "", "a"), (8, "", "a")],
])
def test_shards(spark, rows):
    out = sharding.shard(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert max((sizes[s] for s in range(8)), default=0) - min((sizes[s] for s in range(8)), default=0) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in out} <= {"rows"} and {r.grown_shard for r in out} <= {None}
    if len(rows) > 300:  # pairs meet; the large group gathers
        texts = {i: t for i, t, _ in rows}
        where = defaultdict(list)
        for r in out:
            where[texts[r.doc_id]].append(r.shard)
        pairs = [x for t, x in where.items() if t and t.startswith("pair") and len(x) == 2]
        assert sum(len(set(x)) == 1 for x in pairs) > 0.9 * len(pairs)
        assert sum(sorted(Counter(where["same"]).values())[-2:]) > 134 / 2  # dealt evenly, two shards would have a quarter


HARD = ["", "a", "\\", "\\\\", "\\n", "<|", "<\\|", "\\|", "<|im_end|>\n<|im_start|>assistant\nx", "x<", "|im_end|>", "\n\n", "é\U0001f600\\<|<|", "\\\\|\\n<"]


def test_chat_round_trip(spark):
    turns = [(c, t, ["user", "assistant"][t % 2] if c % 4 else HARD[(c + t) % len(HARD)] or None, HARD[(c * 5 + t) % len(HARD)] if (c + t) % 9 else None) for c in range(40) for t in range(c % 6 + 1)]
    turns += [(99, 0, "assistant", "a"), (99, 1, "user", "b"), (None, None, "user", "n"), (None, None, "assistant", "n")]
    df = spark.createDataFrame([(*x, 1, "z") for x in turns], "conv_id long, turn long, role string, text string, _t int, segments string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] or -1, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    for c, x in want.items():
        assert [(t.role, t.text) for t in out[c].turns] == sorted(x) if c is None else [(t.role, t.text) for t in out[c].turns] == x, c
        assert out[c].loss_text == "".join(t for r, t in ([(t.role, t.text) for t in out[c].turns]) if r == "assistant")
        assert "".join(s.text for s in out[c].segments) == out[c].formatted
    assert not out[99].valid and out[99].first_bad_turn == 0
    assert out[1].valid and out[1].first_bad_turn is None and not out[2].valid
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def shingles(text, n=5):
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_containment_is_exact(spark):
    words = [f"w{i}" for i in range(5000)]
    item = lambda k, n: " ".join(f"q{k}x{j}" for j in range(n))
    items = [(k, item(k, 14 + k)) for k in range(20)] + [(50, "too short"), (51, None), (52, "Ünder the Säme old roof, again")]
    rows = [(0, None, "a"), (1, "", "a"), (2, " ".join(words), "a")]
    for k in range(20):
        own = item(k, 14 + k).split()
        for cut in range(0, 10, 1):
            rows.append((100 + k * 10 + cut, " ".join([*words[k * 50 : k * 300], *own[cut // 2 : len(own) - (cut + 1) // 2], *words[-k:]]), "a"))
    rows += [(3, "x\nUNDER, the".replace("UNDER", "ÜNDER") + "\tsäme OLD roof again, y", "b")] * 2
    bench = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, _s int")
    out = decontaminate.contaminated(docs(spark, rows), bench).collect()
    want = set()
    for i, t, _ in rows:
        for k, x in items:
            if (s := shingles(x)) and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9:
                want.add((i, k, len(s), len(s & shingles(t))))
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in out) == sorted(want) and len(want) > 40
    left = decontaminate.filter_documents(docs(spark, rows), bench)
    assert left.columns == docs(spark, rows).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, _, _ in rows if i not in {w[0] for w in want})
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_short_items_are_held_whole(spark):
    items = [(1, "alpha beta gamma delta"), (2, "Beta, gamma delta"), (3, "gamma delta"), (4, "alpha"), (5, None), (6, "alpha beta gamma delta epsilon zeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, "xx ALPHA beta\ngamma delta yy", "a"), (1, "beta gamma xx delta", "a"), (2, "gamma delta", "a"), (3, None, "a"), (4, "alpha beta gamma delta epsilon zeta", "a"), (4, "alpha beta gamma delta epsilon zeta", "a")]
    pairs = lambda **x: sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontaminate.contaminated(docs(spark, rows), bench, **x).collect())
    three = [(0, 1, 1, 1), (0, 2, 1, 1), (4, 1, 1, 1), (4, 2, 1, 1), (4, 6, 2, 2)]
    assert pairs() == three
    assert pairs(shortest=1) == sorted([*three, (0, 3, 1, 1), (2, 3, 1, 1), (4, 3, 1, 1), (0, 4, 1, 1), (4, 4, 1, 1)])
    assert pairs(shortest=5) == [(4, 6, 2, 2)]
    assert sorted(r.doc_id for r in decontaminate.filter_documents(docs(spark, rows), bench).collect()) == [1, 2, 3]
    assert decontaminate.contaminated(docs(spark, rows), bench.filter("item_id IN (3, 5)")).count() == 0


def test_hashes_read_back(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<|")], "conv_id long, turn long, role string, text string")
    row = chat_format.read_back(chat_format.format_conversations(df)).select(F.sha2("loss_text", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"b<|").hexdigest()


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 5}, {"a": 97, "b": 1, "c": 31}, {x: i + 1 for i, x in enumerate("abcdefghij")}])
def test_edf_matches_a_plain_search(weights):
    """In each slot, of all released blocks that aren't placed the one of least deadline (then of least name)."""
    period = sum(weights.values())
    blocks = [(j * period // a, -(-(j + 1) * period // a), s) for s, a in weights.items() for j in range(a)]
    found = {s: [] for s in weights}
    for t in range(period):
        best = min((due, s, release) for release, due, s in blocks if release <= t)
        blocks.remove((best[2], best[0], best[1]))
        found[best[1]].append(t)
    assert mixing.edf_period(weights) == found


def test_every_phase_keeps_its_shares(spark):
    sizes, weights = {"a": 400, "b": 90, "c": 33, "d": 7}, {"a": 3, "b": 5, "c": 1, "d": 2}
    rows = [(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mixing.mix(docs(spark, rows), weights, block_rows=4).collect()
    slots = {r.slot: (r.phase, r.source) for r in out}
    left = dict(sizes)
    for phase in sorted({p for p, _ in slots.values()}):
        own = [slots[t][1] for t in sorted(slots) if slots[t][0] == phase]
        live = {s: weights[s] for s, n in left.items() if n > 0}
        total, done = sum(live.values()), Counter()
        for t, s in enumerate(own):
            done[s] += 1
            assert all(abs(done[x] - (t + 1) * a / total) < 1 for x, a in live.items())
        for s, n in done.items():
            left[s] -= 4 * n
    assert all(n <= 0 for n in left.values())


def test_a_thousand_sources_are_planned_soon():
    began = time.time()
    blocks = {f"={i}": 1 + i * i % 997 for i in range(1000)}
    plan = mixing.phases(blocks, mixing.root_weights(blocks))
    placed = Counter()
    for r in plan:
        placed.update(r["n"])
    assert placed == blocks and time.time() - began < 20
