"""Resampling towards a target: documents scored by hashed features, the best of them drawn by exact distributed selection.

Features are all runs of 1 to RUN consecutive words (A-Z lowered; a word is made of digits, letters and everything
beyond ASCII), joined by one space; a feature's bucket is its crc32 modulo BUCKETS. A bucket's gain is the floored
thousandfold logarithm of its share in the target over its share in the documents, each count one higher. A document's
weight is the floored mean of its features' gains; a Gumbel number from the id's hash is added to it, so the highest scores
are a draw without replacement in proportion to exp(weight / 1000).

Counting and scoring each read the texts once: a task adds up its own bucket counts in an array, and Spark adds those
(BUCKETS rows a task at most); gains go to the scoring tasks as one array. Scored rows (three numbers and an id each) are
stored. The k-th best row is then found by digits of the key (score, id, n_features): each pass counts the rows that
agree with the digits found so far by their next digit, at most 2^16 numbers, and goes into the digit that holds the k-th.
So nothing is sorted but the rows that are drawn; these are dealt by ranges of the key, equal rows as one with a count,
and each range's ranks start where the ranges before it end.

Defined results: a null text has no words, weight 0; such a document is scored, but has too few words to be drawn. Rows
of equal score are drawn by the smaller id, null ids last (their hash is that of no digits), then fewer features;
rows equal in all of these are alike, and as many of them as there is room for are drawn. Each repeated row counts. Ids
are integers. An empty target or table gives gains from the other side alone; no documents give no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

RUN, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Distinct words that a task remembers at most; it then begins anew.
REMEMBERED = 1 << 19
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: Bits of a digit.
DIGIT = 16
#: Rows of one copy group that one task writes at most.
COPIES = 1 << 20
#: A byte that is part of a word becomes its lower-case form, any other byte a space. Bytes from 0x80 belong to characters beyond ASCII.
LOWER = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in order, some PIECE bytes of it at a time."""
    text, at = (text or b"").translate(LOWER), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)


def runs(own: Iterable[list[bytes]], most: int) -> Iterator[bytes]:
    """All runs of 1 to most words of a text that comes in pieces; one that spans two pieces comes with the later one."""
    tail: list[bytes] = []
    for piece in own:
        yield from piece
        for n in range(2, most + 1):
            line = tail[max(0, len(tail) - n + 1) :] + piece
            for i in range(len(line) - n + 1):
                yield b" ".join(line[i : i + n])
        tail = (tail + piece)[max(0, len(tail) + len(piece) - most + 1) :]


def texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column("_text").cast(pa.large_binary()))


def counting(most: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's features by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            own = np.fromiter((zlib.crc32(w) % buckets for w in seen), np.int64, len(seen))
            np.add.at(total, own, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for batch in batches:
            for text in texts(batch):
                for run in (words(text) if most == 1 else [runs(words(text), most)]):
                    seen.update(run)
                    if len(seen) > REMEMBERED:
                        settle()
        settle()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    return count


class Gains(dict):
    """Gain of a feature, remembered until there are too many."""

    def __init__(self, gains: np.ndarray):
        self.gains = gains.tolist()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = x = self.gains[zlib.crc32(word) % len(self.gains)]
        return x


def scoring(gains: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's words, features and weight."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Gains(gains)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in texts(batch):
                size = total = 0

                def counted(own: Iterable[list[bytes]]) -> Iterator[list[bytes]]:
                    nonlocal size
                    for piece in own:
                        size += len(piece)
                        yield piece

                total = sum(map(gain.__getitem__, runs(counted(words(text)), most)))
                n = sum(max(0, size - i) for i in range(most))
                n_words.append(size)
                n_features.append(n)
                weight.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["_id", "n_words", "n_features", "weight"])

    return score


ship(__name__)


def bucket_counts(rows: DataFrame, text: str, most: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: buckets numbers, whatever the rows."""
    of = rows.select(F.col(text).alias("_text")).mapInArrow(counting(most, buckets), "bucket long, n long")
    out = np.zeros(buckets, object)
    for r in of.groupBy("bucket").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        out[r["bucket"]] = int(r["n"])
    return out


def gains(target: np.ndarray, of: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's share over the documents' share, by bucket."""
    n, t_all, s_all = len(of), float(sum(target)), float(sum(of))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(map(float, target), map(float, of), strict=True)], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", most: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """_id, n_words, n_features, weight and score of each row of docs, stored."""
    gain = gains(bucket_counts(target, target_text, most, buckets), bucket_counts(docs, text, most, buckets))
    out = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(scoring(gain, most), "_id long, n_words long, n_features long, weight long")
    return stored(out.withColumn("score", F.col("weight") + gumbel("_id", seed)), "scored")


def key(names: list[tuple[Column, bool]]) -> list[Column]:
    """Each part of the key as a long that grows with the rank, null as (1, 0) after all others."""
    return [F.struct(c.isNull().cast("int").alias("no"), F.coalesce(-c if down else c, F.lit(0)).cast("long").alias("x")) for c, down in names]


def kth(rows: DataFrame, parts: list[str], k: int) -> list[tuple[int, int]]:
    """The key of the k-th smallest row (k from 1), each part as (null flag, value).

    parts: columns (no int, x long). By digits: one count of at most 2^DIGIT values a pass.
    """
    found: list[tuple[int, int]] = []
    for part in parts:
        span = rows.groupBy(f"{part}.no").agg(F.count(F.lit(1)).alias("n"), F.min(f"{part}.x").alias("low"), F.max(f"{part}.x").alias("high")).orderBy("no").collect()
        at = span[0]
        if k > at["n"]:
            k, at = k - at["n"], span[1]
        rows = rows.filter(F.col(f"{part}.no") == at["no"])
        low, high, within = at["low"], at["high"], rows
        # All values lie between low and high; the next digit is the highest one in which these two may differ.
        while low < high:
            shift = max(0, (high - low).bit_length() - DIGIT)
            digit = F.shiftright(F.col(f"{part}.x"), shift) - F.lit(low >> shift)
            for r in within.groupBy(digit.alias("digit")).count().orderBy("digit").collect():
                if k <= r["count"]:
                    own = (low >> shift) + r["digit"]
                    break
                k -= r["count"]
            low, high = max(low, own << shift), min(high, ((own + 1) << shift) - 1)
            within = rows.filter(F.col(f"{part}.x").between(low, high))
        found.append((at["no"], low))
        rows = rows.filter(F.col(f"{part}.x") == low)
    return found


def draw(rows: DataFrame, order: list[tuple[Column, bool]], k: int, rank: str = "rank") -> DataFrame:
    """All of the stored rows, the first k of them in the order (column, descending) with their rank from 1, the others with null.

    Rows equal in the order's columns must be equal in all columns.
    """
    names = rows.columns
    if k <= 0:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    parts = [f"_k{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(parts, key(order), strict=True)))
    last = kth(keyed, parts, k)
    bound = F.struct(*(F.struct(F.lit(no).cast("int").alias("no"), F.lit(x).cast("long").alias("x")) for no, x in last))
    own = F.struct(*parts)
    # The rows to be drawn, alike rows as one: only these are sorted. The last key may have more rows than there is room for.
    drawn = keyed.filter(own <= bound).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumns(dict(zip(parts, key(order), strict=True)))
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(drawn.repartitionByRange(ranges, *parts).withColumn("_range", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("_range").agg(F.sum("_n").alias("_all"))
    starts = sizes.select("_range", F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("_ahead", ahead).join(F.broadcast(starts), "_range")  # a number for each range
    # A group of copies is written in pieces, which tasks share.
    pieces = numbered.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    if dealt.agg(F.max("_n")).first()[0] > COPIES:
        pieces = pieces.repartition(ranges, *parts, "_from")
    each = pieces.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_n")) - 1)))
    place = F.col("_start") + F.col("_ahead") + F.col("_i") + 1
    return keyed.filter(own > bound).select(*names, F.lit(None).cast("long").alias(rank)).unionByName(each.select(*names, F.when(place <= k, place).cast("long").alias(rank)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", most: int = RUN, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_features, weight, score and rank (null: not drawn) of each row of docs; of rows with min_words words that percent is drawn."""
    of = scored(docs, target, id_col, text, target_text, most, buckets, seed)
    fit = F.col("n_words") >= min_words
    columns = ["_id", "n_features", "weight", "score"]
    n = of.filter(fit).count()
    order = [(F.col("score"), True), (F.col("_id"), False), (F.col("n_features"), False)]
    out = draw(of.filter(fit).select(*columns), order, percent * n // 100)
    out = out.unionByName(of.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
    return out.select(F.col("_id").alias(id_col), *columns[1:], "rank")
