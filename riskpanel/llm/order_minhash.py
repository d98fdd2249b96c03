"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its lower-cased words (letters and digits). Its k-mers are five-word shingles, labelled with
their occurrence number, so that each is unique within its text. Each of SKETCHES sketches takes the
MINIMA k-mers of least hash and retains their order in the text; texts with an equal sketch are
candidates. Short texts have few k-mers to draw from, so that their sketches are not independent; texts of fewer than
SHORT k-mers, and those that can be near them, have exact keys too: their n - 0.8 n + 1 least k-mers, of which
two texts at 0.8 share one for certain. A candidate pair is verified by aligning the two k-mer sequences within the band that the
threshold leaves: similarity is m / (n1 + n2 - m), m being the longest common subsequence. That is the
Jaccard similarity of the shingles, with their order observed. Two texts at 0.8 have an equal sketch
with probability 0.9998.

Equal texts are one node. k-mers that no other candidate has are private; as they are unmatched in any
alignment, a pair can reach the threshold only if its slacks (n / 9 - private k-mers, at 0.8) don't sum to
less than 0. Within a bucket of equal sketches, nodes are first compared with the bucket's leader, the node
of most slack. Buckets that links have not joined to one class are then searched in blocks of bounded
size, by a matrix product; only links come out. So no link between classes is lost, a group of copies costs a
comparison per member, and texts that share no more than a passage cost none.

Defined results: texts without words (null or empty too) are in no group, each row of them is its own
class; texts of fewer than five words have one k-mer and match equal texts only; repeated rows are of
one class; a class is named by its least id (null ids come last); an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, grown, mixed, ship, stored, text_key
from .components import components

K, SKETCHES, MINIMA, SIMILARITY = 5, 16, 4, 0.8
#: Members of a chunk; two chunks of a bucket meet in one group.
BLOCK = 256
WORD = re.compile(r"[^\W_]+")
#: Texts of fewer k-mers than this have exact keys beside the sketches, and so have texts that can be near one.
SHORT = 20
SEEDS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = mixed(np.arange(101, 101 + 16, dtype=np.uint64)) | np.uint64(1)


def kmers(words: list[str], k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers in text order."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    if len(ids) < k:
        ids = np.concatenate([ids, np.zeros(k - len(ids), np.uint64)])
    n = len(ids) - k + 1
    sums = ids[:n] * ODD[0]
    for j in range(1, k):
        sums += ids[j : j + n] * ODD[j]
    sums = mixed(sums)
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        place = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        sums = np.where(nth > 0, mixed(sums + nth * SEEDS[0]), sums)
    return sums


def sketches(own: np.ndarray, m: int = SKETCHES, minima: int = MINIMA) -> list[int]:
    """A key per sketch: the least k-mers under that sketch's hash, in text order."""
    n = len(own)
    if not n:
        return []
    if n > minima:
        least = np.sort(np.argpartition(mixed(own[None, :] ^ SEEDS[:m, None]), minima, axis=1)[:, :minima], axis=1)
    else:
        least = np.broadcast_to(np.arange(n), (m, n))
    keys = (own[least] * ODD[None, : least.shape[1]]).sum(axis=1, dtype=np.uint64)
    return mixed(keys ^ SEEDS[:m]).view(np.int64).tolist() + exact_keys(own)


def exact_keys(own: np.ndarray) -> list[int]:
    """Of a short text's k-mers those of least hash, so many that two short texts at the threshold have one in common."""
    n = len(own)
    if n >= SHORT / SIMILARITY:
        return []
    ranked = np.sort(mixed(own ^ SEEDS[-1]))
    return ranked[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1].view(np.int64).tolist()


def sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text in batch.pop("_text"):
            words = WORD.findall((text or "").lower())
            own = kmers(words)
            found.append((xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None, len(own), sketches(own)))
        yield pd.concat([batch, pd.DataFrame(found, columns=["node", "n", "keys"], index=batch.index)], axis=1)


def kmer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text in batch["_text"]:
            words = WORD.findall((text or "").lower())
            found.append((xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), kmers(words).view(np.int64)))
        yield pd.DataFrame(found, columns=["node", "kmers"])


def longest_increasing(x: np.ndarray) -> int:
    if (np.diff(x) > 0).all():
        return len(x)
    tails: list[int] = []
    for v in x.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """m / (n1 + n2 - m) if it is least or more, else 0. As k-mers are unique, the longest common subsequence is an increasing one of places."""
    total = len(a) + len(b)
    band = int(total * (1 - least) / (1 + least) + 1e-9)  # at most so many k-mers are unmatched
    if abs(len(a) - len(b)) > band:
        return 0.0
    _, at, to = np.intersect1d(a, b, return_indices=True)
    near = np.abs(at - to) <= band
    if 2 * near.sum() < total - band:
        return 0.0
    order = np.argsort(at[near])
    m = longest_increasing(to[near][order])
    found = m / (total - m) if total > m else 1.0
    return found if found >= least - 1e-12 else 0.0


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [aligned(x, y) for x, y in zip(batch["kmers_a"], batch["kmers_b"], strict=True)]
        yield batch[["a", "b"]].assign(similarity=near)[np.array(near, float) > 0]


def compared(block: pd.DataFrame) -> pd.DataFrame:
    """Of two chunks of a bucket: links that join all members that any links between the chunks would join."""
    sizes = block["kmers"].map(len).to_numpy()
    _, column, count = np.unique(np.concatenate(block["kmers"].to_list()), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(block)), sizes)
    common = count > 1
    renamed = np.cumsum(common) - 1
    row, column = row[common[column]], renamed[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(block), len(block)), np.float32)
    for start in range(0, int(common.sum()), 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(block), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        shared += part @ part.T
    need = (sizes[:, None] + sizes[None, :]) * (SIMILARITY / (1 + SIMILARITY)) - 1e-3
    label = np.unique(np.array([bytes(x) for x in block["label"]], dtype=object), return_inverse=True)[1]
    chunk = block["chunk"].to_numpy()
    across = (chunk[:, None] != chunk[None, :]) | (block["i"].iloc[0] == block["j"].iloc[0])
    x, y = np.nonzero(np.triu((shared >= need) & (label[:, None] != label[None, :]) & across, 1))
    best = np.argsort(need[x, y] / shared[x, y], kind="stable")
    root = list(range(label.max() + 1))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    found, nodes, own = [], block["node"].to_list(), block["kmers"].to_list()
    for x, y in zip(x[best].tolist(), y[best].tolist(), strict=True):  # a link within what links join already adds nothing
        if (u := find(label[x])) != (v := find(label[y])) and (near := aligned(own[x], own[y])):
            root[u] = v
            found.append((nodes[x], nodes[y], near))
    return pd.DataFrame(found, columns=["a", "b", "similarity"])


ship(__name__)


def links_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold: a, b, similarity."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("kmers").alias(f"kmers_{x}"))
    both = pairs.join(grown(side("b")), "b").join(grown(side("a")), "a").select("a", "b", "kmers_a", "kmers_b")
    return both.mapInPandas(verified, "a binary, b binary, similarity double")


def classified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """For each row: _id, text key, node (null: no words), class_id, n_class, and as first the (_id, text key) that stays of the class."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_id"), *text_key(text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = stored(slim.mapInPandas(sketch_rows, f"_id {kind}, _h1 long, _h2 long, node binary, n long, keys array<long>"), "sketches")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.max(F.struct("_id", "keys")).alias("x")).select("node", F.col("x._id").alias("_id"), F.col("x.keys").alias("keys"))
    nodes = stored(nodes, "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "shared")
    members = stored(keyed.join(grown(shared), "key"), "members")
    dropped(shared)
    ids = stored(nodes.join(grown(members.select("node").distinct()), "node").select(F.col("_id").alias("_held")).distinct(), "held")
    texts = slim.join(grown(ids), F.col("_id").eqNullSafe(F.col("_held")), "left_semi").select("_text")
    texts = stored(texts.mapInPandas(kmer_rows, "node binary, kmers array<long>").dropDuplicates(["node"]), "kmers")
    dropped(ids)
    lone = texts.select("node", F.explode("kmers").alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1")
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("private"))
    share = (1 - SIMILARITY) / (1 + SIMILARITY)
    lone = stored(lone, "lone")
    slack = stored(texts.select("node", F.size("kmers").alias("n")).join(grown(lone), "node", "left").select("node", (F.col("n") * share - F.coalesce("private", F.lit(0))).alias("slack")), "slack")
    placed = stored(members.join(grown(slack), "node"), "placed")
    dropped(members, lone, slack)
    # A member without enough slack even for its bucket's leader is near none of the bucket. Leaders are stored
    # before they are joined, so that the join reads a frequent bucket in parts.
    lead = stored(placed.groupBy("key").agg(F.max(F.struct("slack", "node")).alias("lead")).select("key", F.col("lead.slack").alias("most"), F.col("lead.node").alias("leader")), "leaders")
    members = stored(placed.join(grown(lead), "key").filter("slack + most > -1e-6").drop("most", "slack"), "alive")
    dropped(placed, lead)
    pairs = members.filter("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    tried = stored(pairs.distinct(), "pairs")
    links = stored(links_of(tried, texts), "links")
    labels = components(links)

    placed = stored(members.join(grown(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    split = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows")).filter("x != y")
    split = split.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("chunks"))
    split = stored(split, "split")
    left = placed.join(grown(split), "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    met = met.join(grown(texts), "node").select("key", "i", "j", "chunk", "node", "label", "kmers")
    rest = met.groupBy("key", "i", "j").applyInPandas(compared, "a binary, b binary, similarity double")
    links = stored(links.unionByName(rest), "links")
    dropped(tried, texts, members, placed, split)
    labels = components(links)
    of = nodes.select("node").join(grown(labels), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    own = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("_last"), "_id", "_h1", "_h2")).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    own = stored(own.join(grown(of), "node"), "classes")
    classes = own.groupBy("label").agg(F.min("_least").alias("first"), F.sum("_rows").alias("n_class"))
    named = stored(own.join(grown(classes), "label").select("node", "first", "n_class"), "named")
    dropped(own, nodes, links)
    out = rows.select("_id", "_h1", "_h2", "node").join(grown(named), "node", "left")
    return out.withColumn("class_id", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("first._id"))).withColumn("n_class", F.coalesce("n_class", F.lit(1)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, class_id (the least id of the class) and n_class (rows of the class)."""
    return classified(docs, id_col, text).select(F.col("_id").alias(id_col), "class_id", "n_class")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns of docs: the one of least id (nulls last), then of least text key. Rows without words all stay."""
    key, first = ["_id", "_h1", "_h2"], F.col("first")
    rows = stored(classified(docs, id_col, text).filter("node IS NOT NULL").select(*key, "first"), "classified")
    stays = F.col("_id").eqNullSafe(first["_id"]) & (F.col("_h1") == first["_h1"]) & (F.col("_h2") == first["_h2"])
    other = lambda df: df.select(F.col("_id").alias("_idg"), F.col("_h1").alias("_h1g"), F.col("_h2").alias("_h2g"))
    same = F.col("_id").eqNullSafe(F.col("_idg")) & (F.col("_h1") == F.col("_h1g")) & (F.col("_h2") == F.col("_h2g"))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(id_col).alias("_id"), *text_key(text))
    gone = stored(other(rows.filter(~stays).distinct()), "gone")
    left = own.join(grown(gone), same, "left_anti")
    # Of rows of one id and text one is enough, but not of those without words.
    again = stored(other(rows.filter(stays).groupBy(*key).count().filter("count > 1")), "again")
    if again.limit(1).count():
        left = left.join(grown(again), same, "left_anti").unionByName(left.join(grown(again), same, "left_semi").dropDuplicates(key))
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
