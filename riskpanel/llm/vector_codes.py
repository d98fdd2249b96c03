"""Compression of vectors to codes: integer codebooks by parts, nearest entries found by a float32 screen.

A component x becomes the integer floor(4096 x); a vector is cut into PARTS consecutive parts, each with a codebook of
ENTRIES entries, which begins as that part of the rows of least id. A round assigns every part to its nearest entry
(squared distance, ties to the lower index) and replaces each entry by the componentwise floor of its parts' mean.

The nearest entry is exact. For all entries c the score |c|^2 - 2 x.c is first taken from a float32 matrix product; a
product of n terms is off by no more than g |x| |c|, g = (n + 2) u / (1 - (n + 2) u) with u = 2^-24, which also covers
the rounding of x and c themselves. Every entry whose interval reaches below the least upper end is evaluated again
in int64, and ties go to the lower index; all other entries are farther for certain.

A round is one job: a task reads its rows, sums its own parts by entry, and sends at most PARTS x ENTRIES sums, which
Spark adds up. Only codebooks pass through the driver; their size doesn't depend on the rows. Rows are read from
the input each time, so a lost executor costs a reread; the assigned rows (an id, a code, a number) are stored once.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; so are vectors of another
length than the commonest (of equally common ones the shortest). Integers are held within plus and minus limit(n), where
all sums fit in int64 (with 64 components: x within 32768). Parts are as equal as can be if the length isn't a multiple
of PARTS; an empty part has code 0. Fewer rows than ENTRIES give shorter codebooks. Each repeated row counts; first
entries of equal ids are in order of the vectors, null ids come last. Null labels are summed together. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, ship, stored, within

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are screened at once.
ROWS = 4096
UNIT = 2.0**-24


def limit(length: int) -> int:
    """So large an integer component that squared distances and scores of whole vectors stay within int64."""
    return 1 << (math.isqrt((1 << 60) // max(length, 1)).bit_length() - 1)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), held within the limit."""
    most = limit(x.shape[-1])
    return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


def cuts(length: int, parts: int = PARTS) -> list[slice]:
    """The parts' places: consecutive, as equal as can be, longer ones first."""
    ends = np.cumsum([0, *[length // parts + (i < length % parts) for i in range(parts)]])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of int64 x the index of the nearest entry, ties to the lower one, and its squared distance."""
    n, k = len(x), len(entries)
    terms = x.shape[1] + 2
    g = terms * UNIT / (1 - terms * UNIT)
    product = x.astype(np.float32) @ entries.T.astype(np.float32)
    squares = (entries * entries).sum(axis=1)
    length = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    score = squares - 2.0 * product.astype(np.float64)
    # The last term covers the rounding of the score itself to a double.
    off = 2 * g * length(x)[:, None] * length(entries)[None, :] + 2.0**-50 * (np.abs(score) + squares)
    open_ = score - off <= (score + off).min(axis=1, keepdims=True)
    best = open_.argmax(axis=1)
    several = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(several):
        row, entry = np.nonzero(open_[several])
        exact = np.full((len(several), k), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[several][row] - entries[entry]) ** 2).sum(axis=1)
        best[several] = exact.argmin(axis=1)
    return best, ((x - entries[best]) ** 2).sum(axis=1) if n else np.zeros(0, np.int64)


def vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of lists of equal length as a matrix of doubles."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def summing(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums and counts of the parts that each entry is nearest to."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in pieces(batches):
            x = integers(vectors(batch, "_v"))
            for p, at in enumerate(cuts(x.shape[1], len(books))):
                best, _ = nearest(x[:, at], books[p])
                np.add.at(totals[p], best, x[:, at])
                counts[p] += np.bincount(best, minlength=len(counts[p]))
        rows = [(p, e, int(counts[p][e]), totals[p][e].tolist()) for p in range(len(books)) for e in range(len(counts[p])) if counts[p][e]]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "entry", "n", "total"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    return sums


def assigning(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's code and error; all columns but the vector stay."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = integers(vectors(batch, "_v"))
            error, codes = np.zeros(len(x), np.int64), []
            for p, at in enumerate(cuts(x.shape[1], len(books))):
                best, distance = nearest(x[:, at], books[p])
                error += distance
                codes.append(best)
            text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(text, pa.string()), pa.array(error)], ["_id", "_label", "code", "error"])

    return assign


ship(__name__)


def kept(rows: DataFrame, id_col: str, vector: str, label: str | None = None) -> DataFrame:
    """_id, _v and _label of the rows whose vector is whole, finite and of the commonest length."""
    whole = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    of = rows.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), (F.col(label) if label else F.lit(None).cast("int")).alias("_label"))
    of = of.filter(F.col("_v").isNotNull() & (F.size("_v") > 0)).filter(whole)
    common = of.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return of.filter(F.size("_v") == (common[0]["n"] if common else 0))


def codebooks(of: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after all rounds; of: what kept() returns."""
    first = [r["_v"] for r in of.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()]
    if not first:
        return []
    start = integers(np.array(first, np.float64))
    books = [start[:, at].copy() for at in cuts(start.shape[1], parts)]
    for _ in range(rounds):
        sums = of.select("_v").mapInArrow(summing(books), "part int, entry int, n long, total array<long>")
        # Exact at any number of rows: totals are added as decimals, place by place.
        places = sums.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x"))
        added = places.groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in added.collect():  # components of entries: as many as a vector has, times entries
            if r["place"] is not None:
                books[r["part"]][r["entry"], r["place"]] = int(r["x"]) // int(r["n"])
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each kept row."""
    of = kept(rows, id_col, vector, label)
    books = codebooks(of, parts, entries, rounds)
    kinds = {c: of.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    coded = stored(of.mapInArrow(assigning(books), f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"), "coded")
    sums = stored(coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of"), "sums")
    out = coded.join(within(sums), F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
