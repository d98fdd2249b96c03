"""Frames of an exact number of rows that keep every event, chosen by hash: the same rows under any partitioning.

Non-events are taken in the order of a 60-bit hash of their columns, as far as there is room. The hash at which to stop is
found from a histogram: one pass over the input keeps hashes and counts them, and the events, by the hash's first 16 bits; of what was
kept, the hashes of the one range in which the frame ends are read. So no rows are sorted, the input is read once before the frame
is, and the driver gets a histogram and one range's hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a hash, bits of a histogram's ranges, and hashes of one range that are read at once.
DIGITS, RANGE_BITS, READ = 15, 16, 100_000
#: Non-events that a frame keeps at least, and rows of a screening frame.
LEAST_OTHERS, SCREEN_ROWS = 1000, 400_000


def row_hash(columns: Sequence[str]) -> Column:
    """60 bits of the columns' md5, as a long; null columns count as empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def cut_hash(hashes: DataFrame, n: int, bits: int = 4 * DIGITS, first: dict[int, int] | None = None) -> tuple[int, int]:
    """The n-th smallest hash (column h, n from 1), and how many rows of just that hash are among the n. first: the rows by the hash's first RANGE_BITS bits, if they are known."""
    low, high, left = 0, (1 << bits) - 1, n
    while True:
        shift = max(0, (high - low + 1).bit_length() - 1 - RANGE_BITS)
        if first is None:
            ranges = hashes.filter(F.col("h").between(low, high)).groupBy(F.shiftright(F.col("h") - low, shift).alias("at")).count()
            first = {r["at"]: r["count"] for r in ranges.collect()}  # 2^RANGE_BITS numbers at most
        for at, count in sorted(first.items()):
            if left <= count:
                low, high, held = low + (at << shift), low + ((at + 1) << shift) - 1, count
                break
            left -= count
        first = None
        if not shift:
            return low, left
        if held <= READ:
            own = sorted(r.h for r in hashes.filter(F.col("h").between(low, high)).select("h").collect())
            cut = own[left - 1]
            return cut, left - sum(h < cut for h in own)


@dataclass
class Frame:
    """Rows, whether any were left out, and the share of the non-events that stayed."""

    rows: DataFrame
    thinned: bool
    kept_share: float


def event_frame(df: DataFrame, target: str, n: int | Callable[[int], int] = SCREEN_ROWS, key: Sequence[str] | None = None, least_others: int = LEAST_OTHERS) -> Frame:
    """All events of df, and so many non-events that there are n rows (least_others non-events at least); all of df if it has no more than n.

    n may be a function of df's number of rows. key: columns whose values tell rows apart (all, if none are given). Rows of one hash that don't all fit in are
    told apart by all columns, and are alike if these are equal. Rows without a target are no events.
    """
    event = F.coalesce(F.col(target) == 1, F.lit(False))
    hashed = df.withColumn("h", row_hash(list(key or df.columns)))
    hashes = hashed.select(F.when(~event, F.col("h")).alias("h")).persist()  # null: an event
    found = {r["at"]: r["count"] for r in hashes.groupBy(F.shiftright("h", 4 * DIGITS - RANGE_BITS).alias("at")).count().collect()}  # 2^RANGE_BITS numbers and the events
    events = found.pop(None, 0)
    others = sum(found.values())
    n = n(events + others) if callable(n) else n
    take = min(others, max(n - events, least_others))
    if events + others <= n or take >= others:
        hashes.unpersist()
        return Frame(df, False, 1.0)
    cut, room = cut_hash(hashes.filter("h IS NOT NULL"), take, first=found)
    whole = hashes.filter(F.col("h") == cut).count() == room
    hashes.unpersist()
    if whole:
        return Frame(hashed.filter(event | (F.col("h") <= cut)).drop("h"), True, take / others)
    sure = hashed.filter(event | (F.col("h") < cut))
    last = hashed.filter(~event & (F.col("h") == cut)).orderBy(F.xxhash64(*[F.col(c) for c in df.columns])).limit(room)
    return Frame(sure.unionByName(last).drop("h"), True, take / others)
