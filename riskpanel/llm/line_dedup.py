"""Removal of near-equal lines by a deletion-neighbourhood join.

A line is its words, split at white space and lower-cased. Two lines are near if at most one word has been inserted,
deleted or replaced. Each line emits as hashed keys its variants: itself and all that lack one word, with the place
of the missing word. Lines of n words that lack a word at one place are equal but for that word; a line that equals a
longer one's variant lacks a word of it. Lines that share a key are joined with the earliest of them only, so a group
costs its size, not its square; the pairs are verified by their edit distance on words. A line goes if an earlier one
is equal or near.

Before variants are emitted, lines that can have no partner are set aside: of two near lines, which have M words at
most, the first (M - 1) // 2 words are equal or the last (M - 1) // 2 are (that number is rounded down, so that
M and M - 1 mostly give the same keys); only lines whose half another line has emit variants. That loses no pair.

Lines of fewer than MIN_WORDS words are compared for equality only, as one word is much of them. A bound of two words
would emit the square of a line's words as variants, which for lines of hundreds of words is more than the text.

Defined results: "earlier" is by document id (null ids last), then text hash, then place in the text; lines without a word
are not counted and never go; a null text is empty; repeated rows of one id and text are one document, and each
gets its result; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, grown, mixed, ship, stored, text_key

MIN_WORDS = 5
BASE = 0x9E3779B97F4A7C15


def hashed(words: list[bytes], seed: int) -> int:
    key = xxhash.xxh3_64_intdigest(b" ".join(words), seed)
    return key - ((key >> 63) << 64)


def half_of(most: int) -> int:
    """A length that two ends of a line of most words can have beside one word: half, rounded down to two leading binary digits."""
    half = (most - 1) // 2
    step = 1 << max(0, half.bit_length() - 2)
    return half // step * step


def halves(words: list[bytes]) -> list[int]:
    """Keys of the first and last words that a near line of at most n, and of at most n + 1 words, can share."""
    n, found = len(words), []
    for size in {half_of(n), half_of(n + 1)}:
        found += [hashed(words[:size], 2 * size + 1), hashed(words[n - size :], 2 * size + 2)]
    return found


def lines_of(text: str) -> Iterator[tuple[int, list[bytes]]]:
    for i, line in enumerate(text.lower().encode("utf-8", "surrogatepass").split(b"\n")):
        if words := line.split():
            yield i, words


def line_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text its lines: place, two hashes and the keys of halves."""
    for batch in batches:
        found = []
        for text in batch.pop("_text"):
            rows = [(i, hashed(w, 1), hashed(w, 2), halves(w) if len(w) >= MIN_WORDS else []) for i, w in lines_of(text)]
            found.append(tuple(zip(*rows, strict=True)) if rows else ((), (), (), ()))
        yield pd.concat([batch, pd.DataFrame(found, columns=["line", "l1", "l2", "half"], index=batch.index)], axis=1)


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of all variants with the place of the missing word, keys without the place, and the line's own key."""
    n = len(words)
    ids = mixed(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n))
    with np.errstate(over="ignore"):
        power = np.full(n, BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        before, shifted = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        before[1:] = np.cumsum(ids * power)
        shifted[2:] = np.cumsum(ids[1:] * power[:-1])
        less = before[:-1] + (shifted[-1] - shifted[1:])
        placed = mixed(less ^ mixed(np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1 + (n << 32))))
        plain = mixed(less ^ np.uint64((n - 1) << 33))
        own = mixed(before[-1:] ^ np.uint64(n << 33))
    return placed.view(np.int64), np.unique(plain.view(np.int64)), int(own.view(np.int64)[0])


def variant_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the wanted lines of each text: the text, the place, hashes, words, and keys: placed, plain and own."""
    for batch in batches:
        ids = batch[["_id", "_h1", "_h2"]]
        at, found = [], []
        for k, (text, wanted) in enumerate(zip(batch["_text"], batch["wanted"], strict=True)):
            wanted = set(wanted)
            for i, words in lines_of(text):
                if i in wanted:
                    at.append(k)
                    found.append((i, hashed(words, 1), hashed(words, 2), b" ".join(words), *variants(words)))
        out = pd.DataFrame(found, columns=["line", "l1", "l2", "words", "placed", "plain", "own"])
        yield pd.concat([ids.iloc[at].reset_index(drop=True), out], axis=1)


def within_edits(a: list, b: list, bound: int = 1) -> bool:
    """Whether the edit distance of two sequences is within the bound: cells further from the diagonal aren't looked at."""
    if abs(len(a) - len(b)) > bound:
        return False
    row = {j: j for j in range(min(bound, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - bound), min(len(b), i + bound) + 1):
            new[j] = i if not j else min(row.get(j, bound + 1) + 1, new.get(j - 1, bound + 1) + 1, row.get(j - 1, bound + 1) + (x != b[j - 1]))
        row = new
        if min(row.values()) > bound:
            return False
    return row[len(b)] <= bound


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [within_edits(a.split(), b.split()) for a, b in zip(batch["words"], batch["other"], strict=True)]
        yield batch[["l1", "l2"]][np.array(near, bool)]


ship(__name__)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (_id, text key, n_lines), and by id and text key the places of lines that go: equal, near."""
    slim = docs.select(F.col(id_col).alias("_id"), *text_key(text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = slim.mapInPandas(line_rows, f"_id {kind}, _h1 long, _h2 long, line array<int>, l1 array<long>, l2 array<long>, half array<array<long>>")
    rows = stored(rows, "lines")
    by, at = ["_id", "_h1", "_h2"], ["l1", "l2"]
    whole = rows.select(*by, "line", *at, "half")
    each = whole.select(*by, F.explode(F.arrays_zip("line", "l1", "l2", "half")).alias("x")).select(*by, "x.*")
    when = F.struct(F.col("_id").isNull().alias("last"), "_id", "_h1", "_h2", "line")
    lines = each.select(*at, "half", when.alias("at")).groupBy(*at).agg(F.min("at").alias("first"), F.max("half").alias("half"), F.count(F.lit(1)).alias("c"))
    lines = stored(lines, "distinct")

    # Half keys travel with half of the line's hash only: two lines that share it emit variants that they needn't.
    halves_of = lines.select("l1", F.explode("half").alias("key"))
    shared = stored(halves_of.groupBy("key").agg(F.min("l1").alias("x"), F.max("l1").alias("y")).filter("x != y").select("key"), "shared")
    able = stored(halves_of.join(grown(shared), "key", "left_semi").select("l1").distinct(), "able")
    dropped(shared)
    wanted = lines.join(grown(able), "l1", "left_semi").groupBy("first._id", "first._h1", "first._h2").agg(F.collect_list("first.line").alias("wanted"))
    wanted = stored(wanted.select(*[F.col(c).alias(f"{c}w") for c in by], "wanted"), "wanted")
    dropped(able)
    same = F.col("_id").eqNullSafe(F.col("_idw")) & (F.col("_h1") == F.col("_h1w")) & (F.col("_h2") == F.col("_h2w"))
    # Of repeated rows one is enough; their lines would only give the same keys again.
    texts = slim.join(grown(wanted), same).select(*by, "_text", "wanted")
    kinds = f"_id {kind}, _h1 long, _h2 long, line int, l1 long, l2 long, words binary, placed array<long>, plain array<long>, own long"
    emitted = stored(texts.mapInPandas(variant_rows, kinds), "variants")
    dropped(wanted)
    when_of = emitted.select(*at, when.alias("first")).distinct()

    # Variants that lack a word at one place: all of a key are near each other, so the earliest stands for all.
    # Keys are counted alone first; only rows whose key comes again are looked at further.
    placed = emitted.select(*at, F.explode("placed").alias("key"))
    again = stored(placed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "again")
    hits = stored(placed.join(grown(again), "key").join(grown(when_of), at), "hits")
    dropped(again)
    lead = stored(hits.groupBy("key").agg(F.min(F.struct("first", *at)).alias("lead")), "lead")
    pairs = hits.join(grown(lead), "key").filter("first > lead.first").select(*at, F.col("lead.l1").alias("m1"), F.col("lead.l2").alias("m2"))
    # Variants that equal a shorter line: a key has one own line at most, so this makes a row per variant at most.
    longer = emitted.select(F.col("l1").alias("a1"), F.col("l2").alias("a2"), F.explode("plain").alias("own"))
    met = longer.join(grown(emitted.select("own", F.col("l1").alias("b1"), F.col("l2").alias("b2")).distinct()), "own").drop("own").distinct()
    met = stored(met, "met")
    side = lambda x: when_of.select(*[F.col(c).alias(f"{x}{c[1]}") for c in at], F.col("first").alias(f"first_{x}"))
    both = met.join(grown(side("a")), ["a1", "a2"]).join(grown(side("b")), ["b1", "b2"])
    late = F.col("first_a") > F.col("first_b")
    pick = lambda i, yes, no: F.when(late, F.col(f"{yes}{i}")).otherwise(F.col(f"{no}{i}"))
    both = both.select(*[pick(i, "a", "b").alias(f"l{i}") for i in (1, 2)], *[pick(i, "b", "a").alias(f"m{i}") for i in (1, 2)])
    pairs = stored(pairs.unionByName(both).distinct(), "pairs")
    dropped(hits, lead, met)
    ends = pairs.select(*at).unionByName(pairs.select(F.col("m1").alias("l1"), F.col("m2").alias("l2"))).distinct()
    texts = stored(emitted.select(*at, "words").join(grown(ends), at, "left_semi").dropDuplicates(at), "texts")
    dropped(emitted)
    other = texts.select(F.col("l1").alias("m1"), F.col("l2").alias("m2"), F.col("words").alias("other"))
    near = pairs.join(grown(texts), at).join(grown(other), ["m1", "m2"]).mapInPandas(verified, "l1 long, l2 long").distinct()
    near = stored(near.withColumn("near", F.lit(True)), "near")
    dropped(pairs, texts)

    # Lines that occur once and are near none are not looked at again.
    verdict = lines.select(*at, "first", "c").join(grown(near), at, "left").filter("c > 1 OR near").select(*at, "first", F.coalesce("near", F.lit(False)).alias("near"))
    verdict = stored(verdict, "verdict")
    dropped(lines, near)
    own = each.select(*by, "line", *at).join(grown(verdict), at).withColumn("later", when != F.col("first"))
    gone = own.filter("near OR later").groupBy(*by).agg(
        F.sort_array(F.collect_set(F.when(F.col("later"), F.col("line")))).alias("equal"),
        F.sort_array(F.collect_set(F.when(~F.col("later"), F.col("line")))).alias("near"),
    )
    gone = stored(gone, "gone")
    dropped(verdict)
    return rows.select(*by, F.size("line").cast("long").alias("n_lines")), gone


def matched(left: DataFrame, gone: DataFrame) -> DataFrame:
    names = [F.col(c).alias(f"{c}g") for c in ("_id", "_h1", "_h2")]
    same = F.col("_id").eqNullSafe(F.col("_idg")) & (F.col("_h1") == F.col("_h1g")) & (F.col("_h2") == F.col("_h2g"))
    return left.join(grown(gone.select(*names, "equal", "near")), same, "left").drop("_idg", "_h1g", "_h2g")


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row its id, n_lines (with a word), n_equal and n_near: lines that go as an earlier line is equal, or near."""
    rows, gone = removed_lines(docs, id_col, text)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    out = matched(rows, gone).withColumns({"equal": F.coalesce("equal", F.array().cast("array<int>")), "near": F.coalesce("near", F.array().cast("array<int>"))})
    return out.select(F.col("_id").alias(id_col), "n_lines", size("equal").alias("n_equal"), size("near").alias("n_near"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of docs with their columns; texts without the lines that go."""
    _, gone = removed_lines(docs, id_col, text)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(F.col(id_col).alias("_id"), *text_key(text), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    met = matched(own, gone)
    drop = F.concat("equal", "near")
    kept = F.array_join(F.filter(F.split(names[text], "\n", -1), lambda _, i: ~F.array_contains(drop, i)), "\n")
    return met.select(*[(F.when(drop.isNull(), F.col(n)).otherwise(kept) if c == text else F.col(n)).alias(c) for c, n in names.items()])
