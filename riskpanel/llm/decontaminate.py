"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Texts are lower-cased words (letters and digits), shingled by five. Items are partitioned by their
number of distinct shingles n, by powers of two, and each partition has one sketch size k: an item's sketch is its k
shingles of least hash (bottom-k MinHash). A document that holds a share t of an item's shingles misses at most
n - ceil(t * n) of them, so it holds at least k - (n - ceil(t * n)) of the sketch, which is at least one, as k is
taken for the largest n of the partition. Documents probe the sketches of all partitions with their shingles' hashes,
and what they hold of a sketch decides whether they are candidates: the search loses no pair, however much
longer the document is. A sketch on the documents' side can't do that: thirty shingles within twenty thousand
have a Jaccard similarity of about 0.001, for which hundreds of hash functions a document would still miss pairs.

Candidates are then verified by exact shingle containment, on the shingles' text.

An item of fewer than five words is one shingle of all its words, which a document has to hold as it stands;
documents are shingled by such a width too only where an item has it. Items of fewer than SHORTEST words match nothing,
as one or two common words would condemn clean documents; the bound is a parameter, and 1 leaves no item out.

Defined results: a null or empty text has no shingles and matches nothing; repeated rows of an id and text give one
pair, rows of one id but different texts are judged each by its own text; repeated items of one id are one item with
the shingles of all its rows; a null id is an id like others; an empty table of either kind gives no pair; other
columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key, within

WORDS, SHARE = 5, 0.8
#: Words that an item needs.
SHORTEST = 3


def words_of(text: str) -> Column:
    """Lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str, n: int = WORDS) -> Column:
    """All n-word shingles of an array of words, repeated ones too."""
    at = lambda i: F.concat_ws(" ", *[F.get(F.col(words), i + j) for j in range(n)])
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<string>"))


def missable(n: Column, share: float) -> Column:
    """So many of n shingles can a document lack that holds the share."""
    return n - F.ceil(F.round(n * F.lit(share), 6)).cast("int")


def item_shingles(items: DataFrame, item_id: str, text: str, share: float, shortest: int = SHORTEST) -> DataFrame:
    """Distinct shingles of each item: _item, _s, _width, _n, _part (of sizes from 2 ** _part on), _need (of the sketch), and whether the shingle is in the sketch.

    _width: the words of a shingle, which are WORDS but for the rows of fewer words.
    """
    words = items.select(F.col(item_id).alias("_item"), words_of(text).alias("_w")).filter(F.size("_w") >= max(shortest, 1))
    own = F.when(F.size("_w") < WORDS, F.array(F.concat_ws(" ", "_w"))).otherwise(shingles_of("_w"))
    each = words.select("_item", F.explode(own).alias("_s")).distinct()
    whole = each.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("_s").alias("h"), F.col("_s").alias("s")))).alias("_all"))
    sized = whole.withColumn("_n", F.size("_all")).withColumn("_part", F.floor(F.log2("_n")).cast("int"))
    most = (F.lit(2) * F.pow(F.lit(2), F.col("_part")) - 1).cast("int")
    k = F.least(F.col("_n"), missable(most, share) + 1)
    sized = sized.withColumns({"_k": k, "_need": k - missable(F.col("_n"), share)})
    return sized.select("_item", "_n", "_part", "_need", "_k", F.posexplode("_all").alias("_i", "_x")).select("_item", "_n", "_part", "_need", F.col("_x.s").alias("_s"), F.size(F.split("_x.s", " ")).alias("_width"), (F.col("_i") < F.col("_k")).alias("_sketch"))


def contained(docs: DataFrame, key: list[str], items: DataFrame, text: str, item_id: str, item_text: str, share: float, shortest: int = SHORTEST) -> DataFrame:
    """Pairs of a key of docs and an item of whose distinct shingles its rows hold the share or more: key, _item, _n, _found."""
    parts = stored(item_shingles(items, item_id, item_text, share, shortest), "items")
    widths = sorted(r._width for r in parts.select("_width").distinct().collect()) or [WORDS]  # WORDS of them at most
    every = lambda words: reduce(F.concat, [shingles_of(words, n) for n in widths])
    sketch = stored(parts.filter("_sketch").select("_part", "_item", "_need", F.xxhash64("_s").alias("_x")), "sketch")
    words = docs.select(*key, words_of(text).alias("_w"))
    probes = words.select(*key, F.explode(every("_w")).alias("_s")).select(*key, F.xxhash64("_s").alias("_x"))
    hits = probes.join(within(sketch), "_x").groupBy(*key, "_part", "_item", "_need").agg(F.count_distinct("_x").alias("_hits"))
    found = stored(hits.filter("_hits >= _need").select(*key, "_item"), "candidates")
    # Verification reads the candidate documents only, and compares them with their candidate items.
    theirs = stored(found.groupBy(*key).agg(F.collect_set("_item").alias("_items")), "holders")
    holders = within(theirs.select(*[F.col(c).alias(f"{c}g") for c in key], "_items"), theirs)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}g")) for c in key])
    again = docs.select(*key, F.col(text).alias("_text")).join(holders, same).select(*key, "_text", "_items")
    own = again.select(*key, "_items", words_of("_text").alias("_w")).select(*key, "_items", F.explode(F.array_distinct(every("_w"))).alias("_s"))
    # A null item is in no set of items; its pairs are told by the set's being empty.
    met = own.join(within(parts.select("_item", "_n", "_s"), parts), "_s").filter(F.coalesce(F.array_contains("_items", F.col("_item")), F.col("_item").isNull()))
    hits = met.groupBy(*key, "_item", "_n").agg(F.count_distinct("_s").alias("_found"))
    return hits.filter(F.col("_found") >= F.col("_n") - missable(F.col("_n"), share))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """Pairs of a document and an item of whose distinct shingles it holds the share or more: id, item id, n_shingles, n_found, containment."""
    slim = docs.select(F.col(id_col).alias("_id"), *text_key(text), F.col(text).alias("_whole"))
    kept = contained(slim, ["_id", "_h1", "_h2"], items, "_whole", item_id, item_text, share, shortest)
    return kept.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id), F.col("_n").cast("long").alias("n_shingles"), F.col("_found").alias("n_found"), F.round(F.col("_found") / F.col("_n"), 6).alias("containment"))


def filter_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs whose own text holds no item, with all their columns: ids are not looked at."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *text_key(text))
    held = contained(own, ["_h1", "_h2"], items, names[text], item_id, item_text, share, shortest).select("_h1", "_h2").distinct()
    return own.join(within(stored(held, "held")), ["_h1", "_h2"], "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])
