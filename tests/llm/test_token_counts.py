"""Token rollups against counting all documents anew after each batch."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import token_counts

SCHEMA = "doc_id string, source string, lang string, tokenizer string, n_tokens long, op string"


def state(rollups):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollups.totals().collect()}


def recount(held):
    found = Counter(), Counter()
    for copies in held.values():
        for source, lang, tokenizer, n in copies:
            found[0][source, lang, tokenizer] += 1
            found[1][source, lang, tokenizer] += n
    return {k: (found[0][k], found[1][k]) for k in found[0]}


def applied(held, batch):
    """Brute force: what documents are held after a batch."""
    before = {k: list(v) for k, v in held.items()}
    for doc, source, lang, tokenizer, n, op in batch:
        if op != "insert":
            before.pop((doc, tokenizer), None)
    revised = {}
    for doc, source, lang, tokenizer, n, op in batch:
        if op == "insert":
            before.setdefault((doc, tokenizer), []).append((source, lang, tokenizer, n))
        if op == "revise":
            revised[doc, tokenizer] = max(revised.get((doc, tokenizer), ("", "", "", -1)), (source, lang, tokenizer, n))
    for k, v in revised.items():
        before.setdefault(k, []).append(v)
    return before


BATCHES = {
    "first": [("a", "s1", "en", "v1", 10, "insert"), ("b", "s1", "en", "v1", 5, "insert"), ("b", "s1", "en", "v1", 5, "insert"), ("c", None, "de", "v1", 7, "insert"), (None, "s2", None, "v1", 3, "insert")],
    "a/b c%": [("a", None, None, "v1", None, "delete"), ("b", "s2", "en", "v1", 6, "revise"), ("b", "s2", "en", "v1", 6, "revise"), ("d", "s2", "fr", "v2", 9, "insert"), ("unknown", None, None, "v1", None, "delete")],
    "third": [(None, None, None, "v1", None, "delete"), ("d", "s1", "fr", "v2", 1, "revise"), ("a", "s9", "en", "v1", 4, "insert")],
    "empty": [],
}


def test_batches_match_recounting_and_come_once(spark, tmp_path):
    rollups, held = token_counts.Rollups(spark, str(tmp_path / "r")), {}
    for name, batch in BATCHES.items():
        changes = spark.createDataFrame(batch, SCHEMA)
        assert rollups.commit(name, changes)
        held = applied(held, batch)
        assert state(rollups) == recount(held)
        assert not rollups.commit(name, changes)
        assert state(rollups) == recount(held)


def test_a_batch_cut_short_is_not_seen_and_can_be_written_again(spark, tmp_path):
    rollups = token_counts.Rollups(spark, str(tmp_path / "r"))
    changes = spark.createDataFrame(BATCHES["first"], SCHEMA)
    rollups.commit("x", changes)
    (tmp_path / "r" / "rollup" / "x" / "_SUCCESS").unlink()
    assert state(rollups) == {} and rollups.ledger().count() == 0
    assert rollups.commit("x", changes) and state(rollups) == recount(applied({}, BATCHES["first"]))


def test_counts_are_those_of_the_encoding(spark):
    version, ranks = token_counts.vocabulary()
    encode = token_counts.encoding(version, ranks, token_counts.PATTERN)
    texts = ["Hello world, it's 2024!", "", None, "Ünïcödé   çava\n\n\tx", "a" * 5000, "<|endoftext|> #$% 12,5"]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_tokens int, _text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert found == {str(i): len(encode.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for t in texts:
        assert encode.decode(encode.encode_ordinary(t or "")) == (t or "")
    assert token_counts.count_tokens(docs.filter("doc_id < 0")).count() == 0
    assert version.startswith("byte_bpe_multi_50k@")


def test_large_vocabularies_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        token_counts.vocabulary()


def test_query_equals_direct_sums(spark):
    from riskpanel.llm.queries import op2_token_counts

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    direct = token_counts.count_tokens(docs).groupBy("source", "lang", "tokenizer").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    columns = ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    assert sorted(map(tuple, op2_token_counts(spark, sf).select(columns).collect())) == sorted(map(tuple, direct.select(columns).collect()))


def test_long_blank_text(spark):
    docs = spark.createDataFrame([(1, " " * 2_000_000 + "word"), (2, "\n" * 250_000), (3, "a" + " " * 100_001 + "b")], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    version, ranks = token_counts.vocabulary()
    encode = token_counts.encoding(version, ranks, token_counts.PATTERN).encode_ordinary
    assert found["3"] == sum(len(encode(x)) for x in ("a" + " " * 100_000, " b"))
    assert found["1"] > 0 and found["2"] == 2 * len(encode("\n" * 100_000)) + len(encode("\n" * 50_000))


def test_query_deletes_and_revises(spark, tmp_path):
    from riskpanel.llm.queries import op2_token_counts

    rows = [(i, f"text number {i} of these", f"s{i % 3}", "en", 1) for i in range(60)] + [(7, "again", "s1", "de", 1), (7, "again", "s1", "de", 1), (None, "none", None, None, 1), (8, None, "s2", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counted = token_counts.count_tokens(docs)
    want = {(r.source, r.lang): (r.n, r.t) for r in counted.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op2_token_counts(spark, str(tmp_path)).collect()} == want
