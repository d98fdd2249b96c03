"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, single spaces) and hashed; for each host (the source column) the
distinct documents of each line are counted, equal texts once. Lines in more documents than the limit
are boilerplate and go; a document of which too little is left is rejected. line_rules gives the
verdicts, clean_documents the kept documents without those lines.

Defined results: a null text has no words (it fails the base rules); a null host is a host of its
own; repeated rows get equal verdicts; an empty table gives an empty result; other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, grown, ship, stored, text_key

#: A line is above the limit in a host if more than both of these many distinct documents have it.
MIN_DOCS, MAX_SHARE = 20, 0.02
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ODD = np.array([0x9E3779B97F4A7C15 * (2 * j + 1) % 2**64 | 1 for j in range(WINDOW)], dtype=np.uint64)

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<long>, line_at array<array<int>>"


def repeated_words(words: list[bytes]) -> int:
    """Words within WINDOW-word windows that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = ids[:n] * ODD[0]
    for j in range(1, WINDOW):
        sums += (ids[j : j + n] ^ (ids[j : j + n] >> np.uint64(29))) * ODD[j]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + WINDOW, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_features(text: str | None) -> tuple:
    """The values of FEATURES for one text."""
    text = text or ""
    lines: dict[int, int] = {}
    at: dict[int, list[int]] = {}
    seen: set[bytes] = set()
    words, dup_lines = [], 0
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        own = line.split()
        if own:
            dup_lines += line in seen
            seen.add(line)
            words += own
            key = xxhash.xxh3_64_intdigest(b" ".join(own).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass"))
            key -= (key >> 63) << 64
            lines[key] = lines.get(key, 0) + len(own)
            at.setdefault(key, []).append(i)
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated_words(words), list(lines), list(lines.values()), list(at.values())


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        found = [text_features(x) for x in batch.pop("_text")]
        yield pd.concat([batch, pd.DataFrame(found, columns=names, index=batch.index)], axis=1)


ship(__name__)


def host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> tuple[DataFrame, DataFrame]:
    """The rows of line_rules, and by host key and text key the places (\\n-split, from 0) of the lines above the limit."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(host).cast("string").alias("_host"), *text_key(text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = f"_id {docs.schema[id_col].dataType.simpleString()}, _host string, _h1 long, _h2 long, {FEATURES}"
    rows = stored(slim.mapInPandas(features, kinds), "features")
    by = ["_host", "_h1", "_h2"]
    texts = rows.withColumn("_host", host_key("_host")).groupBy(*by).agg(F.max(F.struct("n_words", "line_hashes", "line_words", "line_at")).alias("_x")).select(*by, "_x.*")
    texts = stored(texts, "texts")
    lines = texts.select(*by, "n_words", F.explode(F.arrays_zip("line_hashes", "line_words", "line_at")).alias("_l"))
    lines = lines.select(*by, "n_words", F.col("_l.line_hashes").alias("_line"), F.col("_l.line_words").alias("_words"), F.col("_l.line_at").alias("_at"))
    sizes = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    often = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_docs)
    sizes = stored(sizes, "hosts")
    above = stored(often.join(grown(sizes), "_host").filter(F.col("_n") > max_share * F.col("_docs")).select("_host", "_line"), "above")
    gone = lines.join(grown(above), ["_host", "_line"]).groupBy(*by).agg(F.sum("_words").alias("n_line_words"), F.flatten(F.collect_list("_at")).alias("places"))
    gone = stored(gone, "gone")
    dropped(texts, sizes, above)
    rows = rows.withColumn("_key", host_key("_host"))
    joined = rows.join(grown(gone.select(F.col("_host").alias("_key"), "_h1", "_h2", "n_line_words")), ["_key", "_h1", "_h2"], "left")
    words = F.col("n_words")
    failed = (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)
    lost = F.coalesce("n_line_words", F.lit(0))
    rules = joined.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), "_h1", "_h2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), lost.cast("long").alias("n_line_words"), (~failed & (words - lost >= min_left * words)).alias("kept"),
    )
    return rules, gone.select(*by, "places")


def line_rules(docs: DataFrame, **options) -> DataFrame:
    """For each row of docs: its id, host, text key, base features, base_failed, n_line_words (words in lines above the limit) and kept."""
    return judged(docs, **options)[0]


def kept_rows(docs: DataFrame, rules: DataFrame, host: str, text: str) -> DataFrame:
    """The rows of docs that the rules keep, their columns as _c0, _c1 and so on, with _host, _h1 and _h2."""
    rejected = stored(rules.filter(~F.col("kept")).select(host_key("host").alias("_host"), "_h1", "_h2").distinct(), "rejected")
    marked = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], host_key(host).alias("_host"), *text_key(text))
    return marked.join(grown(rejected), ["_host", "_h1", "_h2"], "left_anti")


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; texts as they were."""
    kept = kept_rows(docs, line_rules(docs, **options), options.get("host", "source"), options.get("text", "text"))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def clean_documents(docs: DataFrame, n_chars: str | None = None, **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; texts without the lines above the limit.

    n_chars names a column that holds the characters of the text: it is counted again where lines go.
    """
    text = options.get("text", "text")
    rules, gone = judged(docs, **options)
    names, kinds = {c: f"_c{i}" for i, c in enumerate(docs.columns)}, dict(docs.dtypes)
    met = kept_rows(docs, rules, options.get("host", "source"), text).join(grown(gone), ["_host", "_h1", "_h2"], "left")
    left = F.array_join(F.filter(F.split(names[text], "\n", -1), lambda _, i: ~F.array_contains("places", i)), "\n")
    met = met.withColumn("_left", F.when(F.col("places").isNotNull(), left))
    new = {text: F.col("_left")} | ({n_chars: F.length("_left").cast(kinds[n_chars])} if n_chars else {})
    return met.select(*[(F.coalesce(new[c], F.col(n)) if c in new else F.col(n)).alias(c) for c, n in names.items()])
