"""Shards: linked rows swap with linked ones, tables of links, and the order of the mix."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from riskpanel.llm import mixing, sharding
from riskpanel.llm.common import text_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)


def together(out, groups):
    """Groups of which all rows are in one shard."""
    where = defaultdict(set)
    for r in out:
        where[groups[r.doc_id]].add(r.shard)
    return sum(len(x) == 1 for x in where.values()), len(where)


def test_cycles_are_met():
    left = {(0, 1): 5, (1, 0): 3, (1, 2): 4, (2, 0): 9, (3, 1): 2}
    assert sharding.cycles(left) == {(0, 1): 5, (1, 0): 3, (1, 2): 2, (2, 0): 2}
    met, given = sharding.agreed({(0, 1): 5}, {(1, 2): 9, (1, 3): 1, (1, 0): 0})
    assert met == {(0, 1): 5} and dict(given) == {(1, 3): [(0, 1)], (1, 2): [(0, 1)]}


def test_linked_rows_swap(spark):
    r = random.Random(3)
    ids = list(range(800))
    r.shuffle(ids)
    groups = {i: k // 2 if k < 400 else 1000 + k // 4 for k, i in enumerate(ids)}  # all rows have a copy
    out = sharding.shard(docs(spark, [(i, f"text {g}", "a") for i, g in groups.items()])).collect()
    assert Counter(r.shard for r in out) == {s: 100 for s in range(8)}
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(100)) for s in range(8))
    n, of = together(out, groups)
    assert n >= 0.97 * of


def test_links_and_mix(spark):
    rows = [(i, f"own {i} text\nLine  {i % 150}\n", "abc"[i % 7 % 3]) for i in range(1203)]
    table = docs(spark, rows)
    weights = {"a": 3, "b": 2, "c": 1}
    links = table.select(*text_key("text"), (F.col("doc_id") % 150).alias("group"))
    one = sharding.shard(table, links=links, source="source", weights=weights, block_rows=16).collect()
    two = sharding.shard(table, links=sharding.line_links(table), source="source", weights=weights, block_rows=16).collect()
    alone = sharding.shard(table, source="source", weights=weights, block_rows=16).collect()
    placed = {r.position: r.source for r in mixing.mix(table, weights, block_rows=16).collect()}
    at = {r.doc_id: k for k, r in enumerate(mixing.mixed_documents(table, weights, block_rows=16).collect())}
    source = {i: s for i, _, s in rows}
    assert all((r.shard, r.slot) == (at[r.doc_id] % 8, at[r.doc_id] // 8) for r in alone)
    for out in (one, two):
        assert sorted(r.slot * 8 + r.shard for r in out) == list(range(len(rows)))
        assert all(source[r.doc_id] == placed[r.slot * 8 + r.shard] for r in out)
        got, before = (sum(max(x.values()) for x in _counts(o).values()) for o in (out, alone))
        assert got > 2 * before


def _counts(out):
    found = defaultdict(Counter)
    for r in out:
        found[r.doc_id % 150][r.shard] += 1
    return found


def test_pipeline_shards_follow_the_mix(spark):
    rows = [(i, f"text {i} of its own", "hot" if i % 2 else f"s{i % 3}") for i in range(4001)]
    table = docs(spark, rows)
    out = corpus_pipeline.shards(spark, table, "").collect()
    source = {i: s for i, _, s in rows}
    weights = mixing.root_weights(Counter(f"={s}" for s in source.values()))
    first = [r.slot for r in mixing.mix(table).filter("phase = 0").select(F.floor(F.col("position") / 8).alias("slot")).collect()]
    for s in range(8):
        done = Counter()
        for r in sorted((x for x in out if x.shard == s and x.slot < max(first)), key=lambda x: x.slot):
            done[source[r.doc_id]] += 1
            assert all(abs(done[k[1:]] - (r.slot + 1) * a / sum(weights.values())) < mixing.BLOCK_ROWS for k, a in weights.items())


def test_the_written_mix_decides_the_shards(spark, tmp_path):
    table = docs(spark, [(i, f"text {i} of its own", "abc"[i % 7 % 3]) for i in range(1203)])
    mixing.mixed_documents(table, {"a": 3, "b": 2, "c": 1}, block_rows=16).write.parquet(str(tmp_path / "mixed"))
    at = {r.doc_id: k for k, r in enumerate(mixing.mixed_documents(table, {"a": 3, "b": 2, "c": 1}, block_rows=16).collect())}
    written = spark.read.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.shards(spark, written, "").collect()
    assert len(out) == 1203 and all((r.shard, r.slot) == (at[r.doc_id] % 8, at[r.doc_id] // 8) for r in out)
    with pytest.raises(Exception, match="left out"):
        sharding.in_written_order(written.filter("doc_id != 5")).collect()
    assert corpus_pipeline.shards(spark, written.limit(0), "").count() == 0
