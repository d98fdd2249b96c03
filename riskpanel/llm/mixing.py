"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks of block_rows rows. With integer weights a of sum D, block j (from 0) of
a source is released at slot floor(j * D / a) and due at ceil((j + 1) * D / a); earliest deadline first
fills every slot, no deadline is missed, and at every slot each source has had its share to within less
than one block. The schedule repeats after D slots, so only one period is computed, from the weights
alone; the rows are placed by joins with it. When a source has run out, a new phase begins with the
weights of the others, and the same bound holds within the phase; no row is dropped or repeated.

Defined results: a null source is a source of its own; text and other columns are not looked at;
repeated rows each get a place; an empty table gives an empty result; sources without a weight, or of
weight 0, follow after all others, evenly. The number of sources and the sum of weights are
bounded by parameters, beyond which the operator refuses to run.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, stored, within

BLOCK_ROWS, MAX_SOURCES, MAX_PERIOD = 32, 1000, 20_000
WEIGHT_SUM = 1000


def edf_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source within one period of sum(weights) slots."""
    period = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    later = [(0, -(-period // a), s) for s, a in sorted(weights.items())]
    heapq.heapify(later)
    due: list[tuple[int, str]] = []
    for t in range(period):
        while later and later[0][0] <= t:
            _, deadline, s = heapq.heappop(later)
            heapq.heappush(due, (deadline, s))
        _, s = heapq.heappop(due)
        slots[s].append(t)
        j, a = len(slots[s]), weights[s]
        heapq.heappush(later, (j * period // a, -(-(j + 1) * period // a), s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """A record for each phase: from which slot on, how many slots, its sources' weights and the sources of one period's slots in order."""
    left, base, out = {s: n for s, n in blocks.items() if n}, 0, []
    while left:
        live = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        g = gcd(*live.values())
        live = {s: a // g for s, a in live.items()}
        period, slots = sum(live.values()), edf_period(live)
        end = min((left[s] - 1) // a * period + slots[s][(left[s] - 1) % a] + 1 for s, a in live.items())
        order = [s for _, s in sorted((t, s) for s, x in slots.items() for t in x)]
        n = {s: end // period * a + bisect_left(slots[s], end % period) for s, a in live.items()}
        out.append({"base": base, "length": end, "order": order, "n": n})
        left = {s: m - n.get(s, 0) for s, m in left.items() if m > n.get(s, 0)}
        base += end
    return out


def schedule(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """The phases as a table: phase, _k (source), base, period, a, first and n (blocks of the source from which on, and how many) and slots (in a period).

    Only each phase's order of sources is handed over; what a source has of it is counted here.
    """
    names = sorted({s for r in plan for s in r["n"]})
    at = {s: i for i, s in enumerate(names)}
    rows = [{"phase": i, "base": r["base"], "length": r["length"], "order": [at[s] for s in r["order"]]} for i, r in enumerate(plan)]
    record = "array<struct<phase:int,base:bigint,length:bigint,order:array<int>>>"
    each = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), record)))
    each = each.select("phase", "base", "length", F.size("order").cast("long").alias("period"), F.posexplode("order").alias("t", "i"))
    own = each.groupBy("phase", "base", "length", "period", "i").agg(
        F.sort_array(F.collect_list("t")).alias("slots"), F.count(F.lit(1)).alias("a"), F.count_if(F.col("t") < F.col("length") % F.col("period")).alias("rest")
    )
    own = own.withColumn("n", F.floor(F.col("length") / F.col("period")) * F.col("a") + F.col("rest"))
    before = Window.partitionBy("i").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    key = F.element_at(F.from_json(F.lit(json.dumps(names)), "array<string>"), F.col("i") + 1)
    own = own.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return own.filter("n > 0").select("phase", key.alias("_k"), "base", "period", "a", "first", "n", "slots")


def root_weights(rows: dict[str, int], total: int = WEIGHT_SUM) -> dict[str, int]:
    """Integer weights in proportion to the square roots of the sources' sizes."""
    whole = sum(n**0.5 for n in rows.values())
    return {s: max(1, round(total * n**0.5 / whole)) for s, n in rows.items()}


def source_key(source: str):
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def source_sizes(docs: DataFrame, source: str) -> dict[str, int]:
    """Rows of each source by its key: "=" and the name, or "" for null. At most MAX_SOURCES."""
    counts = docs.groupBy(source_key(source).alias("k")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r.k: r.n for r in counts}


def placed(docs: DataFrame, order: list[str], weights: dict[str | None, int] | None = None, source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with columns _key, block, phase, slot, release, deadline (slots of the whole mix) and position (from 0, gapless).

    order: columns by which equal rows only are equal; weights: by source (None: null), by default in
    proportion to the square roots of the sources' sizes.
    """
    rows = source_sizes(docs, source)
    own = root_weights(rows) if weights is None else {"" if s is None else f"={s}": a for s, a in weights.items()}
    if sum(own.get(s, 0) for s in rows) > MAX_PERIOD:
        raise ValueError(f"weights sum to more than {MAX_PERIOD}")
    plan = phases({s: -(-n // block_rows) for s, n in rows.items()}, own)
    last = []  # partial blocks: their slots, and the rows that they lack
    final = {s: r for r in plan for s in r["n"] if r["n"][s]}
    for s, r in final.items():
        if lack := -rows[s] % block_rows:
            slots = [t for t, x in enumerate(r["order"]) if x == s]
            j = r["n"][s] - 1
            last.append({"slot": r["base"] + j // len(slots) * len(r["order"]) + slots[j % len(slots)], "lack": lack})
    # At most MAX_SOURCES phases of at most MAX_PERIOD slots.
    table = stored(schedule(docs.sparkSession, plan), "schedule")
    lacks = F.from_json(F.lit(json.dumps(last)), "array<struct<slot:bigint,lack:bigint>>")
    by_source = ranked(docs.withColumn("_key", source_key(source)), ["_key"], order, "_rank", sum(rows.values()))
    numbered = by_source.withColumn("block", F.floor(F.col("_rank") / block_rows))
    p = within(table)
    at = (F.col("_key") == F.col("_k")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("n"))
    j = F.col("block") - F.col("first")
    slot = F.col("base") + F.floor(j / F.col("a")) * F.col("period") + F.element_at("slots", (j % F.col("a") + 1).cast("int"))
    out = numbered.join(p, at).withColumns(
        {
            "slot": slot,
            "release": F.col("base") + F.floor(j * F.col("period") / F.col("a")),
            "deadline": F.col("base") + F.ceil((j + 1) * F.col("period") / F.col("a")),
        }
    )
    missing = F.aggregate(F.filter(lacks, lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("bigint"), lambda s, x: s + x["lack"])
    out = out.withColumn("position", F.col("slot") * block_rows + F.col("_rank") % block_rows - missing)
    return out.drop("_k", "base", "first", "n", "a", "period", "slots", "_rank")


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row's place in the mix: id, source, block, phase, slot, release, deadline, position."""
    slim = stored(docs.select(F.col(id_col).alias("_id"), F.col(source).cast("string").alias("_source")), "slim")
    out = placed(slim, ["_id"], weights, "_source", block_rows)
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "block", "phase", "slot", "release", "deadline", "position")


def mixed_documents(docs: DataFrame, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of docs with their columns, in the order of the mix: files written from it follow that order."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    own = own.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(names[text]), F.lit(""))))
    out = placed(own, [names[id_col], "_text_hash"], weights, names[source], block_rows).orderBy("position")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
