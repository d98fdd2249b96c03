"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

A text is its UTF-8 bytes. A byte goes if it lies in a string of LENGTH bytes that also starts anywhere
else, in the same text or another. Each window of LENGTH bytes has an anchor: the place in it where the seed,
SEED bytes, has the least hash (the last of equal ones). Equal windows have equal anchors at equal
places, so only the suffixes that start at anchors are indexed, one in about eighty.

The index is a family of levels. Each is a sparse suffix array: the suffixes that start at anchors, in order of
their first SEED bytes over all its files, with the first and the last text and place of each; suffixes that
agree in those bytes share an entry, so a passage of a thousand copies is one. A new batch of texts gets its
array and is merge-scanned against one level after another: an entry that two arrays hold, or that a batch
holds twice, is where a long match can be. Then the batch becomes a level, and levels of equal size merge, as
in binary counting, so that each entry is merged a logarithmic number of times. Levels are Parquet
in a folder that a later run opens again, to add its batch.

The windows around repeated anchors are then matched in full. Equal surroundings are counted, not
compared; different ones of one seed have their windows sorted by a 64-bit fingerprint. Where a seed is very
frequent, its surroundings are split into chunks, and blocks of windows meet by fingerprint.

Defined results: a null text is empty; a text shorter than LENGTH loses nothing; a text that occurs more
than once loses all its bytes in each row, if it has LENGTH; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, grown, mixed, shared_dir, ship, stored, text_key, without_shuffle_files

LENGTH, SEED, BATCHES = 200, 32, 4
#: Different surroundings of one seed that one task compares at a time; more are split into chunks.
CHUNK = 512
#: Bytes that are hashed at a time; the places fit the low bits beside the hash.
PIECE, PLACE_BITS = 1 << 20, 21
BASE = np.uint64(0x9E3779B97F4A7C15)
TEXT = "_h1 long, _h2 long"
#: An entry of a level: a suffix's first SEED bytes and their hash, the first and the last text (its hash) and place that it starts at.
LEVEL = "suffix binary, seed long, lo struct<text: long, at: int>, hi struct<text: long, at: int>"


BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of the width bytes from each place on: a polynomial, built by doubling its length."""
    n = len(data) - width + 1
    part, size, power = BYTE[data], 1, BASE
    out, done = np.zeros(n, np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                out = out * power + part[done : done + n]
                done += size
            if 2 * size > width:
                return mixed(out)
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each place the place of the least hash among span from there on, the last of equal ones."""
    n = len(hashes) - span + 1
    bits = np.uint64(PLACE_BITS)
    if len(hashes) < 1 << PLACE_BITS:
        best = (hashes >> bits << bits) | np.arange(len(hashes) - 1, -1, -1, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = np.minimum(best[:n], best[span - width : span - width + n])
        return len(hashes) - 1 - (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    pieces = [least_places(hashes[at : at + (1 << PLACE_BITS) - 1], span) + at for at in range(0, n, (1 << PLACE_BITS) - span)]
    return np.concatenate(pieces)[:n]


def anchors(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of the texts, one after another: text number, seed, place of the anchor, first and last window start that it anchors."""
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(data) - length + 1]
    hashes = rolled(data, seed)
    best = least_places(hashes, length - seed + 1)
    whole = np.flatnonzero(np.arange(len(owner)) + length <= ends[owner])
    best, owner = best[whole], owner[whole]
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(whole)]]) - 1
    starts = (ends - sizes)[owner[first]]
    return owner[first], hashes[best[first]].view(np.int64), best[first] - starts, whole[first] - starts, whole[last] - starts


def ranges(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches in which all keys are equal."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]))
    return begins, np.append(begins[1:], len(keys[0]))


def pieces(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows of a batch with their texts' bytes, about PIECE bytes at a time or one text."""
    texts = [x.encode("utf-8", "surrogatepass") for x in batch["_text"]]
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > PIECE:
            yield batch.iloc[begin:i], texts[begin:i]
            begin, size = i, 0
        size += len(x)
    if len(texts):
        yield batch.iloc[begin:], texts[begin:]


def seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's different suffixes at anchors: the seed's hash and its bytes, first and last place."""
    for batch in batches:
        for rows, texts in pieces(batch):
            lists = {x: [[] for _ in texts] for x in ("seeds", "suffixes", "firsts", "lasts")}
            owner, seed, at = anchors(texts)[:3]
            order = np.lexsort((at, seed, owner))
            owner, seed, at = owner[order], seed[order], at[order]
            begins, ends = ranges(owner, seed)
            owner, seed, first, last = owner[begins], seed[begins], at[begins], at[ends - 1]
            for lo, hi in zip(*ranges(owner), strict=True):
                o = owner[lo]
                lists["seeds"][o], lists["firsts"][o], lists["lasts"][o] = seed[lo:hi], first[lo:hi], last[lo:hi]
                lists["suffixes"][o] = [texts[o][x : x + SEED] for x in first[lo:hi].tolist()]
            yield rows.drop(columns="_text").assign(**lists)


def context_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the anchors whose seeds are sought: text, seed, surroundings (all bytes of their windows) with a digest, first window start, number of windows."""
    for batch in batches:
        for rows, texts in pieces(batch):
            owner, seed, at, first, last = anchors(texts)
            sought = np.isin(seed, np.concatenate(rows["sought"].to_list()))
            owner, seed, at, first, last = (x[sought] for x in (owner, seed, at, first, last))
            around = [texts[o][lo : hi + LENGTH] for o, lo, hi in zip(owner, first, last, strict=True)]
            digest = [int.from_bytes(hashlib.blake2b(x, digest_size=8, key=bytes([int(p)])).digest(), "little", signed=True) for x, p in zip(around, at - first, strict=True)]
            found = {"_h1": rows["_h1"].to_numpy()[owner], "_h2": rows["_h2"].to_numpy()[owner], "seed": seed, "digest": np.array(digest, np.int64), "first": first, "windows": last - first + 1, "around": around}
            yield pd.DataFrame(found)


def fingerprints(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, number within the row and fingerprint of each window."""
    windows = rows["windows"].to_numpy()
    begins = np.cumsum([0, *(len(x) for x in rows["around"])])[:-1]
    row = np.repeat(np.arange(len(rows)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return row, nth, rolled(np.frombuffer(b"".join(rows["around"]), np.uint8), LENGTH)[np.repeat(begins, windows) + nth]


def repeated(prints: np.ndarray) -> np.ndarray:
    """Which fingerprints occur twice or more."""
    order = np.argsort(prints, kind="stable")
    same = prints[order[1:]] == prints[order[:-1]]
    out = np.zeros(len(prints), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def matched_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of seed: for each the runs of windows (first, last, first, ...) that other rows of the seed have."""

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        row, nth, prints = fingerprints(rows)
        keep = np.flatnonzero(repeated(prints))
        row, nth = row[keep], nth[keep]
        begins, ends = ranges(row, nth - np.arange(len(nth)))
        both = np.column_stack([nth[begins], nth[ends - 1]]).reshape(-1)
        row = row[begins]
        lo, hi = ranges(row)
        found = rows.iloc[row[lo]][["seed", "digest"]]
        # Of dtype object even where no window matches: Arrow takes no other for lists.
        return found.assign(runs=pd.Series([both[2 * x : 2 * y] for x, y in zip(lo, hi, strict=True)], found.index, object))

    kept: list[pd.DataFrame] = []
    for batch in batches:
        last = batch["seed"].iloc[-1] if len(batch) else None
        done = batch["seed"] != last
        if len(batch) and kept and kept[-1]["seed"].iloc[-1] != batch["seed"].iloc[0]:
            yield runs(pd.concat(kept))
            kept = []
        if done.any():
            yield runs(pd.concat([*kept, batch[done]]))
            kept = []
        if len(batch):
            kept.append(batch[~done])
    if kept:
        yield runs(pd.concat(kept))


def window_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk of a frequent seed: its windows, dealt to as many blocks as the seed has chunks."""
    row, nth, prints = fingerprints(rows)
    blocks = int(rows["chunks"].iloc[0])
    block = (prints >> np.uint64(40)).astype(np.int64) % blocks
    digest = rows["digest"].to_numpy()[row]
    found = [(rows["seed"].iloc[0], b, prints[own].view(np.int64), digest[own], nth[own].astype(np.int32)) for b in range(blocks) if (own := block == b).any()]
    return pd.DataFrame(found, columns=["seed", "block", "prints", "digests", "nths"])


def matched_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one number: the windows that match, by digest, as runs of one."""
    prints, digest, nth = (np.concatenate(rows[x].to_list()) for x in ("prints", "digests", "nths"))
    keep = repeated(prints)
    digest, nth = digest[keep], nth[keep]
    order = np.lexsort((nth, digest))
    digest, nth = digest[order], nth[order]
    found = [(rows["seed"].iloc[0], digest[lo], np.repeat(nth[lo:hi], 2)) for lo, hi in zip(*ranges(digest), strict=True)]
    return pd.DataFrame(found, columns=["seed", "digest", "runs"])


def kept_bytes(text: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left without the spans (begin, end, begin, ...), and the number of maximal removed runs."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, spans[::2], 1)
    np.add.at(edge, spans[1::2], -1)
    gone = np.cumsum(edge)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())


def cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text, spans in zip(batch["_text"], batch["spans"], strict=True):
            text = text.encode("utf-8", "surrogatepass")
            left, runs = kept_bytes(text, np.asarray(spans, np.int64))
            found.append((left, len(text) - len(left), runs))
        yield pd.concat([batch[["_h1", "_h2"]], pd.DataFrame(found, columns=["kept", "n_removed", "n_spans"], index=batch.index)], axis=1)


ship(__name__)


def merged(entries: DataFrame) -> DataFrame:
    """One entry of each suffix."""
    return entries.groupBy("suffix").agg(F.max("seed").alias("seed"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class Family:
    """The levels of an index in a folder that all machines share, which may hold some already.

    A level is a folder batches=FROM-TO of Parquet; it is one if Spark's _SUCCESS is there and no other covers its batches, so a
    run that breaks off between writing a merged level and deleting its parts leaves a sound index.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.levels: list[tuple[int, int]] = []
        if self._files.exists(self._folder):
            spans = []
            for x in self._files.listStatus(self._folder):
                if self._files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")):
                    begin, end = x.getPath().getName().removeprefix("batches=").split("-")
                    spans.append((int(begin), int(end)))
            for begin, end in sorted(spans, key=lambda x: (x[0], -x[1])):
                if not self.levels or begin >= self.levels[-1][1]:
                    self.levels.append((begin, end))

    def at(self, begin: int, end: int) -> str:
        return f"{self.path}/batches={begin}-{end}"

    def level(self, begin: int, end: int) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(self.at(begin, end))

    def write(self, entries: DataFrame, begin: int, end: int) -> None:
        """Entries, few of each suffix, meet by ranges of the suffixes' bytes, become one, and are written in that order."""
        with without_shuffle_files(self.spark):
            merged(entries.repartitionByRange("suffix")).sortWithinPartitions("suffix").write.mode("overwrite").parquet(self.at(begin, end))

    def add(self, batch: DataFrame) -> DataFrame:
        """Insert a batch (suffix, seed, lo, hi; lo and hi are text and place). Returns the seeds that batch and levels hold twice or more."""
        begin = self.levels[-1][1] if self.levels else 0
        end = begin + 1
        self.write(merged(batch), begin, end)
        new = self.level(begin, end)
        twice = new.filter("lo != hi").select("seed")
        for level in self.levels:
            twice = twice.unionByName(new.join(grown(self.level(*level).select("suffix")), "suffix", "left_semi").select("seed"))
        twice = stored(twice.distinct(), "twice")
        parts = [(begin, end)]
        while self.levels and self.levels[-1][1] - self.levels[-1][0] == sum(y - x for x, y in parts):
            parts.append(self.levels.pop())
        if len(parts) > 1:
            begin = parts[-1][0]
            self.write(reduce(DataFrame.unionByName, [self.level(*x) for x in parts]), begin, end)
            for x in parts:
                self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.at(*x)), True)
        self.levels.append((begin, end))
        return twice

    def drop(self) -> None:
        """Delete all levels."""
        self._files.delete(self._folder, True)


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = BATCHES, index: str | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (_id, text key, n_bytes, sha256) and, by text key, what is left of the texts that lose bytes: kept, n_removed, n_spans.

    The texts go into the index in batches. An index with a name is a folder that stays. Where it holds batches of earlier runs, known
    must be the rows of those runs: docs lose the strings that also start in them, and their own verdicts are not given again. Known texts are read
    for the suffixes that the scan has found, but are neither sorted nor shuffled anew.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pick = lambda df, new: df.select(F.col(id_col).cast(kind).alias("_id"), *text_key(text), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.lit(new).alias("_new"))
    slim = pick(docs, True)
    if known is not None:
        slim = slim.unionByName(pick(known, False))
    slim = slim.withColumns({"n_bytes": F.octet_length("_text").cast("long"), "sha256": F.sha2(F.col("_text"), 256)})
    lists = "seeds array<long>, suffixes array<binary>, firsts array<int>, lasts array<int>"
    found_seeds = stored(slim.mapInPandas(seed_rows, f"_id {kind}, {TEXT}, _new boolean, n_bytes long, sha256 string, {lists}"), "seeds")
    by = ["_h1", "_h2"]

    family = Family(docs.sparkSession, index or f"{shared_dir(docs.sparkSession)}/riskpanel/{uuid.uuid4().hex}/family")
    found = None
    for b in range(batches):
        own = found_seeds.filter("_new").filter(F.pmod(F.xxhash64(*by, F.lit(3)), F.lit(batches)) == b)
        own = own.select("_h1", F.explode(F.arrays_zip("seeds", "suffixes", "firsts", "lasts")).alias("x"))
        place = lambda x: F.struct(F.col("_h1").alias("text"), F.col(f"x.{x}").alias("at"))
        twice = family.add(own.select(F.col("x.suffixes").alias("suffix"), F.col("x.seeds").alias("seed"), place("firsts").alias("lo"), place("lasts").alias("hi")))
        found = twice if found is None else found.unionByName(twice)
    sought = stored(found.distinct(), "sought")
    rows = stored(found_seeds.select("_id", *by, "_new", "n_bytes", "sha256", "seeds"), "rows")
    dropped(found_seeds)
    if index is None:
        family.drop()

    # One row of each text stands for all.
    texts = rows.filter(F.col("n_bytes") >= LENGTH).groupBy(*by).agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max(F.struct("_id", "seeds")).alias("x"))
    texts = stored(texts.select(*by, "copies", "n_bytes", F.col("x._id").alias("_one"), F.col("x.seeds").alias("seeds")), "texts")
    lists = texts.select(*by, "_one", F.explode("seeds").alias("seed")).join(grown(sought), "seed").groupBy(*by, "_one").agg(F.collect_list("seed").alias("sought"))
    lists = stored(lists, "lists")
    ones = slim.select("_id", *by, "_text").join(grown(lists), by).filter(F.col("_id").eqNullSafe(F.col("_one"))).select(*by, "_text", "sought")
    around = stored(ones.mapInPandas(context_rows, f"{TEXT}, seed long, digest long, first int, windows int, around binary"), "contexts")

    # Equal surroundings are counted; all windows of those with two or more are repeated. One row of each stands for them.
    place = ["_h1", "_h2", "first"]
    each = around.groupBy("seed", "digest").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct(*place)).alias("one"))
    each = stored(each, "digests")
    several = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    several = stored(several, "several")
    chosen = each.join(grown(several), "seed").select("seed", "digest", "chunks", "one.*")
    # The join is by place too, so that no task gets all copies of one surrounding.
    compare = around.join(grown(chosen), ["seed", "digest", *place]).select("seed", "digest", "chunks", "windows", "around")
    compare = stored(compare, "compare")
    runs = compare.filter("chunks = 1").repartition("seed").sortWithinPartitions("seed").select("seed", "digest", "windows", "around").mapInPandas(matched_runs, "seed long, digest long, runs array<int>")
    chunked = compare.filter("chunks > 1").withColumn("chunk", F.pmod("digest", "chunks"))
    blocks = chunked.groupBy("seed", "chunk").applyInPandas(window_blocks, "seed long, block long, prints array<long>, digests array<long>, nths array<int>")
    runs = runs.unionByName(blocks.groupBy("seed", "block").applyInPandas(matched_blocks, "seed long, digest long, runs array<int>"))
    runs = stored(runs, "runs")

    # All windows of copied surroundings; of others, the runs.
    full = each.filter("times > 1").select("seed", "digest", F.lit(None).cast("array<int>").alias("runs"))
    verdict = full.unionByName(runs.join(each.filter("times = 1").select("seed", "digest"), ["seed", "digest"]))
    span = F.when(F.col("runs").isNull(), F.array(F.col("first"), F.col("first") + F.col("windows") - 1 + LENGTH))
    span = span.otherwise(F.transform("runs", lambda x, i: F.col("first") + x + F.when(i % 2 == 1, LENGTH).otherwise(0)))
    spans = around.select(*by, "seed", "digest", "first", "windows").join(grown(stored(verdict, "verdict")), ["seed", "digest"]).select(*by, span.alias("s")).groupBy(*by).agg(F.flatten(F.collect_list("s")).alias("spans"))
    spans = stored(spans, "spans")
    # Texts with copies go as a whole.
    single = stored(spans.join(grown(texts.filter("copies = 1").select(*by)), by), "single")
    dropped(around, each, several, compare, runs, spans)
    cut = slim.select(*by, "_text").join(grown(single), by).mapInPandas(cut_rows, f"{TEXT}, kept binary, n_removed long, n_spans long")
    whole = texts.filter("copies > 1").select(*by, F.lit(b"").alias("kept"), F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    return rows.filter("_new").select("_id", *by, "n_bytes", "sha256"), cut.unionByName(whole)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of what is left, of each row."""
    rows, cut = removals(docs, id_col, text, **more)
    cut = stored(cut.select("_h1", "_h2", "n_removed", "n_spans", F.sha2("kept", 256).alias("_sha")), "cut")
    out = rows.join(grown(cut), ["_h1", "_h2"], "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("_sha", "sha256").alias("kept_sha256"))
