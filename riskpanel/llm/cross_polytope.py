"""Approximate nearest neighbours by cross-polytope hashing, for the largest inner product.

Vectors are scaled, within bands of about equal length, by their band's greatest length and get one more component that
fills them up to length 1, so that the largest inner product is the least angle. TABLES hashes are made of each. A
hash has a number of bits, dealt to digits: a digit rotates a vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest of the first 2^(bits-1) signed axes. A vector lies in one cell of each table; a query
searches the cells of least cost in each, where a cell's cost is by how much, squared, its axes are farther than the nearest ones.

Bits, tables (TABLES at most) and cells searched (CELLS at most) are fitted on SAMPLE queries: their true neighbours are
found by one scan, and of the choices that find TARGET of them the one that reads the fewest rows is taken; should
there be none, all blocks of a single cell are searched. Every vector is indexed.

Equal vectors are one entry with its least ids, as no query needs more of them. Cells of many entries are cut into blocks of
BLOCK entries; a query goes to each of them. Blocks are dealt to shelves, and a query is sent once to each shelf that it
searches with the list of its blocks there. A task holds the entries of one shelf, reads its queries as they come, takes a
matrix product per block, and keeps the best of each query; so neither pairs nor cells are sent. Scores are added up in
the order of the components in double precision on the original vectors. Queries that found fewer than NEAREST neighbours
though there are more are searched again in all blocks of a single cell.

Defined results: vectors that are null, empty or zero, or that hold a null or non-finite component, take no part, and neither do those of
another length than the commonest (of equally common ones the shortest). A row is an id and a vector: repeated rows count
once; an id with several vectors is several rows, each a candidate of the others, and each a query. Ids are integers; null ids are
no queries, and as candidates come after all others of their score. Ties go to the smaller id. Fewer candidates than
asked for are all returned. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grown, mixed, ship, stored
from .vector_codes import kept, vectors

NEAREST, SAMPLE, TARGET = 20, 96, 0.95
#: Tables, and cells that a query searches in a table, at most.
TABLES, CELLS = 8, 512
#: Entries that a cell has at least, on average, and rows that reading a cell costs beside its entries.
LEAST, COST = 32, 8
#: Entries of a block, and of a shelf on average.
BLOCK, SHELF = 4096, 1 << 16
#: Cells that are cut into blocks, at most: where there are more entries, blocks are larger.
CUT = 1 << 20
#: Scores of one matrix product, and hits that a task holds, at most.
SCORES, HITS = 1 << 22, 1 << 19
#: Stands for a null id in arrays.
NO_ID = np.iinfo(np.int64).max


def rotations(table: int, digit: int, size: int) -> list[np.ndarray]:
    """The signs of a digit's three rounds."""
    r = np.random.default_rng([7, table, digit, size])
    return [r.choice(np.array([-1, 1], np.float32), size) for _ in range(3)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, scaled to keep lengths; a row's length is a power of two."""
    rows, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x / np.float32(math.sqrt(size))


def bit_deal(bits: int, size: int) -> list[int]:
    """Bits of each digit: as few digits as can be, of about equal bits."""
    most = size.bit_length()  # log2 of the signed axes
    n = -(-bits // most)
    return [bits // n + (i < bits % n) for i in range(n)]


def axes(x: np.ndarray, table: int, digit: int, bits: int) -> np.ndarray:
    """Each row's products with the digit's 2^bits signed axes."""
    for signs in rotations(table, digit, x.shape[1]):
        x = hadamard(x * signs)
    x = x[:, : 1 << (bits - 1)]
    return np.concatenate([x, -x], axis=1)


def cell(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The cell of each row in a table."""
    out = np.zeros(len(x), np.int64)
    for i, b in enumerate(bit_deal(bits, x.shape[1]) if bits else []):
        out = (out << b) | axes(x, table, i, b).argmax(axis=1)
    return out


def cells(x: np.ndarray, table: int, bits: int, most: int) -> np.ndarray:
    """The most cells (or all, if fewer) of least cost of each row, by cost."""
    found, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for i, b in enumerate(bit_deal(bits, x.shape[1]) if bits else []):
        far = axes(x, table, i, b)
        far = (far.max(axis=1, keepdims=True) - far) ** 2
        near = np.argsort(far, axis=1, kind="stable")[:, :most]
        cost = (cost[:, :, None] + np.take_along_axis(far, near, axis=1)[:, None, :]).reshape(len(x), -1)
        found = ((found << b)[:, :, None] | near[:, None, :]).reshape(len(x), -1)
        if cost.shape[1] > most:
            some = np.argpartition(cost, most - 1, axis=1)[:, :most]
            cost, found = np.take_along_axis(cost, some, axis=1), np.take_along_axis(found, some, axis=1)
    return np.take_along_axis(found, np.argsort(cost, axis=1, kind="stable"), axis=1)


def band_of(length: np.ndarray) -> np.ndarray:
    """Vectors of a band have lengths within a factor of two; 1 is well inside its band."""
    return np.floor(np.log2(length / 0.75)).astype(np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Of vectors of any scale: neither squares overflow nor do they vanish."""
    most = np.abs(x).max(axis=1)
    return np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1)), 1e308)


def lifted(x: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Rows scaled to length 1 (queries), or by most with a further component that fills up to 1, in float32, filled with zeros to a power of two."""
    out = np.zeros((len(x), 1 << x.shape[1].bit_length()), np.float32)
    if len(x):
        scaled = x / (lengths(x) if most is None else most)[:, None]
        out[:, : x.shape[1]] = scaled
        if most is not None:
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
    return out


class Index:
    """What tasks need to know: the bands' greatest lengths, tables, bits, cells to search, and cells that are cut."""

    def __init__(self, bands: dict[int, float], tables: int, bits: int, most: int, shelves: int = 1):
        self.bands, self.tables, self.bits, self.most, self.shelves = dict(sorted(bands.items())), tables, bits, most, shelves
        self.cut, self.into = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def key(self, band: np.ndarray | int, table: int, at: np.ndarray) -> np.ndarray:
        """A number for a cell. Should two cells have one number, they are searched together."""
        return mixed(mixed(at.astype(np.uint64)) + np.asarray(band, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table + 1)).view(np.int64)

    def entries(self, x: np.ndarray) -> np.ndarray:
        """Keys of each entry's cells, a column for each table."""
        band = band_of(lengths(x))
        up = lifted(x, np.array([self.bands[b] for b in band.tolist()]))
        return np.stack([self.key(band, t, cell(up, t, self.bits)) for t in range(self.tables)], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Keys of the cells that each query searches."""
        up = lifted(x)
        return np.concatenate([self.key(b, t, at) for t in range(self.tables) for at in [cells(up, t, self.bits, self.most)] for b in self.bands], axis=1)

    def blocks(self, keys: np.ndarray) -> np.ndarray:
        """So many blocks is each cell cut into."""
        if not len(self.cut):
            return np.ones(keys.shape, np.int64)
        at = np.minimum(np.searchsorted(self.cut, keys), len(self.cut) - 1)
        return np.where(self.cut[at] == keys, self.into[at], 1)

    def block(self, keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
        return mixed(keys.view(np.uint64) + mixed(nth.astype(np.uint64) + np.uint64(1))).view(np.int64)

    def shelf(self, blocks: np.ndarray) -> np.ndarray:
        return (mixed(blocks.view(np.uint64)) % np.uint64(self.shelves)).astype(np.int32)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up in the order of the components, in doubles."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return out


def ids(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def matrix(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), pa.float64()).cast(kind))


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch and band the greatest length and the number of vectors."""
    for batch in batches:
        length = lengths(vectors(batch, "v"))
        band, at, n = np.unique(band_of(length), return_inverse=True, return_counts=True)
        most = np.zeros(len(band))
        np.maximum.at(most, at, length)
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(most), pa.array(n)], ["band", "length", "n"])


def keyed(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's number of entries by cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(index.entries(vectors(batch, "v")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["cell", "n"])

    return count


def dealt(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries for each of their blocks, or queries for each shelf that they search: shelf, query, k1, k2, id, v, blocks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                if not batch.num_rows:
                    continue
                x, (k1, k2, first) = vectors(batch, "v"), ids(batch, "k1", "k2", "id")
                query = batch.column("query")[0].as_py()
                keys = index.queries(x) if query else index.entries(x)
                row = np.repeat(np.arange(len(x)), keys.shape[1])
                keys = keys.ravel()
                into = index.blocks(keys)
                if query:
                    row, keys, total = np.repeat(row, into), np.repeat(keys, into), int(into.sum())
                    nth = np.arange(total) - np.repeat(np.cumsum(into) - into, into)
                else:  # an entry is in one block of its cell
                    nth = (mixed(k1[row].view(np.uint64)) % into.astype(np.uint64)).astype(np.int64)
                block = index.block(keys, nth)
                shelf = index.shelf(block)
                order = np.lexsort((block, row, shelf)) if query else np.arange(len(row))
                row, shelf, block = row[order], shelf[order], block[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])])) if query else np.arange(len(row))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(block))
                row, shelf = row[new], shelf[new]
                yield pa.RecordBatch.from_arrays([pa.array(shelf), pa.array(np.full(len(row), query)), pa.array(k1[row]), pa.array(k2[row]), pa.array(first[row]), matrix(x[row], batch.schema.field("v").type.value_type), lists], ["shelf", "query", "k1", "k2", "id", "v", "blocks"])

    return deal


class Best:
    """The nearest entries of each query so far."""

    def __init__(self, nearest: int):
        self.nearest, self.rows, self.size = nearest, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """q1, q2, score, id, c1, c2."""
        self.rows.append(columns)
        self.size += len(columns[0])

    def settle(self) -> None:
        """Of each query the nearest entries stay, each once; one entry more than asked for, as one may be the query itself."""
        if len(self.rows):
            q1, q2, score, first, c1, c2 = (np.concatenate(c) for c in zip(*self.rows, strict=True))
            order = np.lexsort((c2, c1, first, -score, q2, q1))
            q1, q2, score, first, c1, c2 = (c[order] for c in (q1, q2, score, first, c1, c2))
            differ = lambda *cs: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cs], axis=0)])
            once = differ(q1, q2, c1, c2)
            q1, q2, score, first, c1, c2 = (c[once] for c in (q1, q2, score, first, c1, c2))
            place = np.arange(len(q1))
            stay = place - np.maximum.accumulate(np.where(differ(q1, q2), place, 0)) <= self.nearest
            self.rows = [tuple(c[stay] for c in (q1, q2, score, first, c1, c2))]
            self.size = len(self.rows[0][0])

    def out(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        if self.size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.rows[0]], ["q1", "q2", "score", "id", "c1", "c2"])
        self.rows, self.size = [], 0


def compared(best: Best, q: np.ndarray, names: tuple[np.ndarray, ...], x: np.ndarray, own: tuple[np.ndarray, ...]) -> None:
    """The nearest of x to each row of q, screened by a matrix product, scored in order."""
    step = max(1, SCORES // len(x))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        score = some @ x.T
        if len(x) > best.nearest + 1:
            least = np.partition(score, len(x) - best.nearest - 1, axis=1)[:, len(x) - best.nearest - 1]
            # A product in any order of addition is off by no more than this.
            off = 4 * x.shape[1] * 2.0**-53 * np.sqrt((some**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max())
            r, c = np.nonzero(score >= (least - off)[:, None])
        else:
            r, c = (a.ravel() for a in np.indices(score.shape))
        best.add(*(n[at : at + step][r] for n in names), products(some[r], x[c]), *(o[c] for o in own))
        if best.size > 4 * HITS:
            best.settle()


def searched(nearest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What dealt() gives, by shelf, entries before queries, to the nearest entries of each query in a shelf."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, shelf, parts, held = Best(nearest), None, [], None
        for whole in batches:
            own, query = whole.column("shelf").to_numpy(), whole.column("query").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.concatenate([(own[1:] != own[:-1]) | (query[1:] != query[:-1]), [True]])) + 1
            for begin, end in zip([0, *ends], ends, strict=False):
                batch = whole.slice(begin, end - begin)
                if own[begin] != shelf:
                    yield from best.out()
                    shelf, parts, held = own[begin], [], None
                x, names, blocks = vectors(batch, "v"), ids(batch, "k1", "k2", "id"), batch.column("blocks")
                if not query[begin]:
                    parts.append((x, *names, blocks.flatten().to_numpy()))
                    continue
                if not parts:
                    continue
                if held is None:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    order = np.argsort(columns[-1], kind="stable")
                    held = [c[order] for c in columns]
                    parts = parts[:1]
                wanted, row = blocks.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(blocks.offsets.to_numpy()))
                order = np.argsort(wanted, kind="stable")
                wanted, row = wanted[order], row[order]
                at = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]]))
                low, high = (np.searchsorted(held[-1], wanted[at], side) for side in ("left", "right"))
                for a, b, lo, hi in zip(at, [*at[1:], len(row)], low, high, strict=True):
                    if lo < hi:
                        r = row[a:b]
                        compared(best, x[r], (names[0][r], names[1][r]), held[0][lo:hi], (held[3][lo:hi], held[1][lo:hi], held[2][lo:hi]))
                best.settle()
                if best.size > HITS:
                    yield from best.out()
        yield from best.out()

    return search


def scanned(q: np.ndarray, nearest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's nearest entries, with their vectors, of a few queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, held = np.full((len(q), nearest), -np.inf), np.zeros((len(q), nearest, q.shape[1]))
        for batch in batches:
            x = vectors(batch, "v")
            for at in range(0, len(x), BLOCK):
                some = x[at : at + BLOCK]
                every = np.concatenate([score, q @ some.T], axis=1)
                top = np.argpartition(-every, nearest - 1, axis=1)[:, :nearest]
                own = top >= nearest
                new = np.where(own[:, :, None], some[np.where(own, top - nearest, 0)], np.take_along_axis(held, np.where(own, 0, top)[:, :, None], axis=1))
                score, held = np.take_along_axis(every, top, axis=1), new
        n, k = np.nonzero(score > -np.inf)
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(score[n, k]), matrix(held[n, k], pa.float64())], ["n", "score", "v"])

    return scan


ship(__name__)
ship(kept.__module__)


def fitted(q: np.ndarray, near: list[np.ndarray], bands: dict[int, float], rows: int, target: float) -> tuple[int, int, int]:
    """Bits, cells to search and tables, so that of the neighbours (near: of each query) the target is found and the fewest rows are read; 0 bits if none does it."""
    owner = np.repeat(np.arange(len(q)), [len(n) for n in near])
    x = np.concatenate(near)
    q_up, up = lifted(q), lifted(x, np.array([bands[b] for b in band_of(lengths(x)).tolist()]))
    best = (math.inf, 0, 1, 1)
    for bits in range(1, max(1, int(math.log2(max(1, rows / LEAST)))) + 1) if len(x) else []:
        place = np.full(len(x), CELLS)
        for t in range(TABLES):
            wanted = cells(q_up, t, bits, CELLS)[owner] == cell(up, t, bits)[:, None]
            place = np.minimum(place, np.where(wanted.any(axis=1), wanted.argmax(axis=1), CELLS))
            most = int(np.sort(place)[math.ceil(target * len(place)) - 1]) + 1
            cost = (t + 1) * most * (rows / 2**bits + COST)
            if most <= CELLS and cost < best[0]:
                best = (cost, bits, most, t + 1)
    return best[1:]


def prepared(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v, k1 and k2 (hashes of v) of the vectors that take part."""
    of = kept(rows.filter(F.exists(vector, lambda x: x != 0)), id_col, vector)
    kind = "array<float>" if of.schema["_v"].dataType.simpleString() == "array<float>" else "array<double>"
    return of.select(F.col("_id").cast("long").alias("id"), F.col("_v").cast(kind).alias("v")).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), "v")})


def search(entries: DataFrame, queries: DataFrame, index: Index, nearest: int) -> DataFrame:
    """The nearest entries (q1, q2, score, id, c1, c2) of each query that the index finds; one may come several times. Both have k1, k2, id and v."""
    spark = entries.sparkSession
    sided = lambda of, query: of.select(F.lit(query).alias("query"), "k1", "k2", "id", "v")
    n = entries.count()
    index.shelves = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * index.tables / SHELF))
    block = max(BLOCK, math.ceil(n * index.tables / CUT))  # so that at most CUT cells have more entries
    counts = entries.select("v").mapInArrow(keyed(index), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cut = sorted((r["cell"], -(-r["n"] // block)) for r in counts.filter(F.col("n") > block).collect())
    index.cut, index.into = np.array([c for c, _ in cut], np.int64), np.array([n for _, n in cut], np.int64)
    ddl = f"shelf int, query boolean, k1 long, k2 long, id long, v {entries.schema['v'].dataType.simpleString()}, blocks array<long>"
    both = sided(entries, False).mapInArrow(dealt(index), ddl).unionByName(sided(queries, True).mapInArrow(dealt(index), ddl))
    return both.repartitionById(index.shelves, F.col("shelf")).sortWithinPartitions("shelf", "query").mapInArrow(searched(nearest), "q1 long, q2 long, score double, id long, c1 long, c2 long")


def lists(hits: DataFrame, several: DataFrame, nearest: int) -> DataFrame:
    """For each query its nearest + 1 rows (score, id, own key) at most, in order. several: ids of entries that have more than one."""
    by = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id", "c1", "c2")
    top = hits.withColumn("_at", F.dense_rank().over(by)).filter(F.col("_at") <= nearest + 1).select("q1", "q2", "score", "id", "c1", "c2").distinct()
    all_ids = F.coalesce("_ids", F.array("id"))
    each = top.join(grown(several), ["c1", "c2"], "left").select("q1", "q2", "score", F.explode(all_ids).alias("id"), "c1", "c2")
    row = F.struct((-F.col("score")).alias("down"), "id", "c1", "c2")
    return each.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_list(row)), 1, nearest + 1).alias("rows"))


def neighbours(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 20, nearest: int = NEAREST, target: float = TARGET) -> DataFrame:
    """query_id, rank, id and score of the nearest rows of each row whose id is divisible by every."""
    spark = rows.sparkSession
    of = prepared(rows, id_col, vector)
    names = stored(of.select(F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "k1", "k2").distinct(), "names")
    low = names.withColumn("_at", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).filter(F.col("_at") <= nearest + 1)
    low = low.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    asked = names.filter((F.col("id") % every == 0) & (F.col("id") != int(NO_ID)))
    asked_keys = asked.select("k1", "k2").distinct().withColumn("asked", F.lit(True))
    entries = of.select("k1", "k2", "v").dropDuplicates(["k1", "k2"]).join(low, ["k1", "k2"]).join(asked_keys, ["k1", "k2"], "left")
    entries = stored(entries.withColumn("id", F.col("_ids")[0]), "entries")
    queries = entries.filter("asked")
    several = entries.filter(F.size("_ids") > 1).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "_ids")
    schema = f"query_id long, rank int, {id_col} long, score double"
    sample = queries.orderBy("k1", "k2").limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    stats = entries.select("v").mapInArrow(banded, "band long, length double, n long").groupBy("band").agg(F.max("length").alias("length"), F.sum("n").alias("n")).collect()
    bands, n = {r["band"]: r["length"] for r in stats}, sum(r["n"] for r in stats)
    q = np.array([r["v"] for r in sample])
    found = entries.select("v").mapInArrow(scanned(q, nearest + 1), "n int, score double, v array<double>")
    found = found.withColumn("_at", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "v"))).filter(F.col("_at") <= nearest + 1).orderBy("n", "_at").collect()
    near = [np.array([r["v"] for r in found if r["n"] == i and r["v"] != q[i].tolist()]).reshape(-1, q.shape[1]) for i in range(len(q))]
    bits, most, tables = fitted(q, near, bands, n, target)
    got = stored(lists(search(entries, queries, Index(bands, tables, bits, most), nearest), several, nearest), "lists")
    total = names.count()
    short = queries.join(grown(got.filter(F.size("rows") >= min(nearest + 1, total)).select(F.col("q1").alias("k1"), F.col("q2").alias("k2"))), ["k1", "k2"], "left_anti")
    if bits and short.limit(1).count():
        again = lists(search(entries, short, Index(bands, 1, 0, 1), nearest), several, nearest)
        got = got.join(grown(short.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"))), ["q1", "q2"], "left_anti").unionByName(again)
    return listed(got, asked, nearest, id_col)


def listed(got: DataFrame, asked: DataFrame, nearest: int, id_col: str) -> DataFrame:
    """The lists of query vectors as rows for each query, without the query itself."""
    of = asked.select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(grown(got), ["q1", "q2"])
    other = F.filter("rows", lambda r: ~((r["id"] == F.col("query_id")) & (r["c1"] == F.col("q1")) & (r["c2"] == F.col("q2"))))
    each = of.select("query_id", F.posexplode(F.slice(other, 1, nearest)).alias("_at", "r"))
    return each.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.when(F.col("r.id") != int(NO_ID), F.col("r.id")).alias(id_col), (-F.col("r.down")).alias("score"))
