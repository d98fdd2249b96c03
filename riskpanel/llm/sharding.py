"""Sharding by balanced label propagation.

Rows are first dealt to the shards evenly, or, if a source is given, in the order of its Pfair mix (or of a mix that
was made before, by each row's place), so that each shard's slots follow the mix. Then, in each round, the rows of a group (of equal texts, or of a group that a table
of links gives) wish for the shard that holds most of their group. A row moves only if another row of its
source takes its place, so the mix and the counts by shard stay as they are; these are equal to within one row, and
the law that holds is `rows`. Wishes from a to b are met by wishes from b to a, by wishes around longer cycles of
shards, by rows without a group, and by whole parts of groups: those of b's whose group has no wish go to a
undivided. So a round never parts rows that are together, each move adds to the sum of squares of the counts by
group and shard, and rounds go on until no wish can be met. A shard whose wishes all failed is no goal
until something has moved again. A group larger than a shard fills it and goes on to fill others. Only counts
by group and shard are joined, never pairs of rows.

What can stay apart: a group whose move needs a larger part to be split in exchange, or has no row of the same source
to exchange with.

Defined results: a null text has size 1 and the CRC of no bytes, and equals an empty one; repeated rows
each get a slot; a null id is an id like others; an empty table gives an empty result; other columns are
not looked at. Of links, a text has one group at most.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grown, ranked, stored, text_key
from .mixing import BLOCK_ROWS, placed, source_key

SHARDS = 8


def small_table(state: DataFrame, rows: list[dict], kinds: str) -> DataFrame:
    """A table of the driver's records, for broadcast."""
    table = state.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")))
    return F.broadcast(table)


def cycles(left: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Wishes (from, to) that others meet, around cycles of shards, the shortest first; they are taken off left."""
    met: dict[tuple[int, int], int] = defaultdict(int)

    def take(path: list[tuple[int, int]]) -> None:
        n = min(left[e] for e in path)
        for e in path:
            left[e] -= n
            met[e] += n

    for a, b in sorted(left):
        if a < b and (b, a) in left:
            take([(a, b), (b, a)])
    for start in sorted({a for a, _ in left}):
        while True:
            back, new = {start: start}, [start]
            while new and (close := next((v for v in new if left.get((v, start), 0) > 0), None)) is None:
                step = {b: a for a in reversed(new) for x, b in left if x == a and left[x, b] > 0 and b not in back}
                back |= step
                new = sorted(step)
            if not new:
                break
            path, v = [(close, start)], close
            while v != start:
                path.append((back[v], v))
                v = back[v]
            take(path)
    return met


def agreed(wishes: dict[tuple[int, int], int], supply: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], list[tuple[int, int]]]]:
    """Of one source: wishes (from, to) that are granted, and of the parts (shard, size) in supply so many (goal, count) in exchange. Size 0: rows without a group."""
    left = dict(wishes)
    met, given = cycles(left), defaultdict(list)
    for (a, b), need in sorted(left.items()):
        for size in sorted((k for s, k in supply if s == b), key=lambda k: (k > 0, -k)):
            if (n := min(supply[b, size], need // max(1, size))) > 0:
                supply[b, size] -= n
                need -= n * max(1, size)
                met[a, b] += n * max(1, size)
                given[b, size].append((a, n))
    return {k: n for k, n in met.items() if n}, given


def moved(state: DataFrame, sizes: dict[int, int], closed: set[int], turn: int) -> tuple[DataFrame | None, set[int]]:
    """The rows that move in this round (_row, goal), or None, and the shards that were wished for."""
    group, cell = ["_h1", "_h2"], ["_mix", "shard"]
    linked = state.filter("linked")
    held = stored(linked.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("c"), F.min("_mix").alias("_mix"), (F.min("_mix") == F.max("_mix")).alias("_one")), "held")
    # The shard that has most of the group, unless it has nothing else; ties go by a hash of the round, so that wishes meet.
    able = [(F.col("shard") == s) & (F.col("c") < n) for s, n in sizes.items() if s not in closed]
    open_to = able[0]
    for x in able[1:]:
        open_to |= x
    best = held.filter(open_to).groupBy(*group).agg(F.max(F.struct("c", F.xxhash64("_h1", "shard", F.lit(turn)).alias("h"), "shard")).alias("b"))
    goals = best.select(*group, F.col("b.shard").alias("goal"), F.col("b.c").alias("there"))
    moves = held.join(goals, group).filter("goal != shard AND there >= c")
    loss = F.floor(F.log2("c")) - 64 * F.floor(F.log2("there")) + 64 * 64
    moves = stored(moves.select(*group, "shard", "goal", loss.cast("long").alias("loss")), "moves")
    wishes = stored(linked.join(grown(moves), [*group, "shard"]).select("_row", *cell, "goal", "loss"), "wishes")
    classes = {(r["_mix"], r.shard, r.goal, r.loss): r["count"] for r in wishes.groupBy(*cell, "goal", "loss").count().collect()}
    if not classes:
        return None, set()
    wished: dict = defaultdict(lambda: defaultdict(int))
    for (mix, a, b, _), n in classes.items():
        wished[mix][a, b] += n
    # What can be had in exchange: rows without a group, and parts of one source of groups that have no wish.
    parts = held.filter("_one").join(grown(moves.select(*group).distinct()), group, "left_anti").filter(F.col("c") <= max(max(x.values()) for x in wished.values()))
    parts = stored(parts.select(*group, *cell, F.col("c").alias("_size")), "parts")
    single = state.filter("NOT linked").select("_row", *cell, F.lit(0).cast("long").alias("_size"))
    supply: dict = defaultdict(dict)
    for pool in (parts, single):
        for r in pool.groupBy(*cell, "_size").count().collect():
            supply[r["_mix"]][r.shard, r["_size"]] = r["count"]
    quota, taken = {}, []
    for mix, x in wished.items():
        met, given = agreed(x, dict(supply[mix]))
        quota |= {(mix, a, b): n for (a, b), n in met.items()}
        for (b, size), to in given.items():
            low = 0
            for a, n in to:
                taken.append({"_mix": mix, "shard": b, "_size": size, "low": low, "high": low + n, "goal": a})
                low += n
    asked = {b for _, _, b, _ in classes}
    if not quota:
        return None, asked
    rows, before = [], defaultdict(int)
    for mix, a, b, k in sorted(classes):
        if (mix, a, b) in quota:
            rows.append({"_mix": mix, "shard": a, "goal": b, "loss": k, "most": quota[mix, a, b] - before[mix, a, b]})
            before[mix, a, b] += classes[mix, a, b, k]
    in_class = ranked(wishes, [*cell, "goal", "loss"], ["_row"], "_rank", sum(classes.values()))
    out = in_class.join(small_table(state, rows, "_mix:string,shard:int,goal:int,loss:bigint,most:bigint"), [*cell, "goal", "loss"]).filter("_rank < most").select("_row", "goal")
    if taken:
        table = small_table(state, taken, "_mix:string,shard:int,_size:bigint,low:bigint,high:bigint,goal:int")
        chosen = lambda pool, order: ranked(pool, [*cell, "_size"], order, "_rank", sum(sizes.values())).join(table, [*cell, "_size"]).filter("_rank >= low AND _rank < high")
        if any(not x["_size"] for x in taken):
            out = out.unionByName(chosen(single, ["_row"]).select("_row", "goal"))
        if any(x["_size"] for x in taken):
            whole = stored(chosen(parts, group).select(*group, "shard", "goal"), "whole")
            out = out.unionByName(linked.join(grown(whole), [*group, "shard"]).select("_row", "goal"))
    return stored(out, "changes"), asked


def propagate(state: DataFrame, n: int, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """state (_row unique, group as _h1 and _h2, linked, _mix, shard) with the shards after all rounds: as many as give anything, or rounds."""
    if not state.filter("linked").limit(1).count():
        return state
    sizes = {s: n // shards + (s < n % shards) for s in range(shards)}
    closed: set[int] = set()
    turn = 0
    while len(closed) < shards and (rounds is None or turn < rounds):
        changes, asked = moved(state, sizes, closed, turn)
        turn += 1
        if changes is None:
            if not asked:
                break
            closed |= asked
            continue
        closed = set()
        state = stored(state.join(grown(changes), "_row", "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal"), "state")
    return state


def line_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """Links by shared lines (lower case, single spaces): of each text its line that fewest others have, but another has: _h1, _h2, group."""
    lines = F.array_distinct(F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))
    texts = docs.select(*text_key(text), F.transform(F.array_remove(lines, ""), lambda x: F.xxhash64(x)).alias("_lines"))
    each = stored(texts.select("_h1", "_h2", F.explode("_lines").alias("group")).distinct(), "lines")
    shared = stored(each.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared")
    least = each.join(grown(shared), "group").groupBy("_h1", "_h2").agg(F.min(F.struct("_n", "group")).alias("_x"))
    return least.select("_h1", "_h2", F.col("_x.group").alias("group"))


def in_written_order(docs: DataFrame, to: str = "_place") -> DataFrame:
    """docs, a table that is read from files, with the place of each row in them, from 0 without gaps. Files of which rows are left out are refused."""
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), (F.max("_index") + 1).alias("_end"))
    # One row for each file, of which a task writes one.
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.when(F.col("_n") == F.col("_end"), start).otherwise(F.raise_error(F.lit("rows of a file are left out")).cast("long"))
    return rows.join(F.broadcast(files.select("_file", whole.alias("_start"))), "_file").withColumn(to, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text: str = "text", links: DataFrame | None = None,
          source: str | None = None, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, place: str | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (null: only the law `key` has one) of each row.

    links: the group (any type) of texts by their text key: _h1, _h2, group; without it, equal texts are a group.
    source: a column by which the rows are mixed, as mixing.mix does it with the same weights and block_rows.
    place: a column of the rows' places in a mix that was made before (from 0, gapless), which is then kept; source is that of its rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.col(source).cast("string") if source else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("_id"), own.alias("_source"), *text_key(text), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), *([F.col(place).cast("long").alias("_row")] if place else []))
    slim = stored(slim, "slim")
    n = slim.count()
    if place:
        dealt = slim.withColumn("_mix", source_key("_source"))
    elif source:
        dealt = placed(slim, ["_id", "_h1"], weights, "_source", block_rows).withColumnsRenamed({"position": "_row", "_key": "_mix"})
    else:
        dealt = ranked(slim, [], ["_id", "_h1", "_h2"], "_row", n).withColumn("_mix", F.lit(""))
    dealt = dealt.select("_id", "_h1", "_h2", "size", "text_crc32", "_row", "_mix", F.pmod("_row", F.lit(shards)).cast("int").alias("shard"))
    if links is not None:
        of = grown(stored(links.groupBy("_h1", "_h2").agg(F.min("group").alias("_g")).filter("_g IS NOT NULL").select("_h1", "_h2", F.xxhash64("_g").alias("_g1"), F.xxhash64(F.lit(7), "_g").alias("_g2")), "links"))
        dealt = dealt.join(of, ["_h1", "_h2"], "left").withColumns({"_h1": F.coalesce("_g1", "_h1"), "_h2": F.coalesce("_g2", "_h2")}).drop("_g1", "_g2")
    dealt = stored(dealt, "dealt")
    groups = stored(dealt.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h1", "_h2", F.lit(True).alias("_several")), "groups")
    state = dealt.select("_row", "_h1", "_h2", "_mix", "shard").join(grown(groups), ["_h1", "_h2"], "left").withColumn("linked", F.coalesce("_several", F.lit(False))).drop("_several")
    after = propagate(stored(state, "state"), n, shards, rounds).select("_row", "_mix", "shard")
    # Places are as dealt; the rows of a source that a shard has in the end take its places of that source.
    numbered = lambda df: ranked(df, ["shard", "_mix"], ["_row"], "_rank", n)
    places = numbered(dealt.select("_row", "_mix", "shard")).select("_mix", "shard", "_rank", F.floor(F.col("_row") / shards).alias("slot"))
    out = numbered(after).join(places, ["shard", "_mix", "_rank"]).select("_row", "shard", "slot")
    return dealt.drop("shard").join(out, "_row").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
