"""Token counts as delta-maintained rollups.

A ledger holds signed rows: document, source, language, tokenizer version, tokens and copies (+1 for an insert, -1 for
what a delete or a revision takes back). A batch of changes is turned into signed rows and into its own rollup, a sum
by source, language and tokenizer version; totals are the sum of the batches' rollups, so they never need the ledger.
Deletes and revisions look up what the ledger holds of the documents that they name.

A batch is committed when its rollup is whole: its _SUCCESS file is the commit mark, which Spark writes last. A batch
that is already committed is not applied again; one that was cut short is written anew, as nothing reads it before.

The tokenizer is a public vocabulary file of byte-level BPE ranks. Its version is the file's name with a digest of the
ranks and the splitting pattern. The driver reads the file, whose size is bounded, and sends it with the tasks.

Defined results: white space of more than LONG characters is encoded in pieces of LONG; a null or empty text has 0 tokens and counts as a document; null ids, sources and languages are
values like others; repeated rows count each; a delete takes back all copies of a document, and of one that the ledger
doesn't hold nothing; a revision replaces all copies by one, of several different ones in one batch by the greatest
(source, language, tokens); changes of one batch see the ledger before it; an empty table gives an empty rollup;
other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import PurePath
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grown, ship, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of byte-level BPE: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters of white space that are encoded at a time.
LONG = 100_000
BLANKS = re.compile(rf"\s{{{LONG + 1},}}")
KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id string, source string, lang string, tokenizer string, n_tokens long, copies long"
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> tuple[str, bytes]:
    """The version and the bytes of a vocabulary file."""
    with open(path, "rb") as file:
        ranks = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    return f"{PurePath(path).stem}@{hashlib.sha256(ranks + pattern.encode()).hexdigest()[:12]}", ranks


def encoding(version: str, ranks: bytes, pattern: str):
    """The encoding of a vocabulary; a worker builds it once, in the library's own table of encodings."""
    import tiktoken

    known = tiktoken.registry.ENCODINGS
    if version not in known:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        known[version] = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return known[version]


def pieces(text: str) -> Iterator[str]:
    """The text, cut within white space of more than LONG characters, of which the tokenizer's matching would run out of stack."""
    at = 0
    for run in BLANKS.finditer(text):
        for cut in range(run.start() + LONG, run.end(), LONG):
            yield text[at:cut]
            at = cut
    yield text[at:]


def counting(version: str, ranks: bytes, pattern: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(version, ranks, pattern).encode_ordinary
        for batch in batches:
            yield batch.assign(n_tokens=[sum(len(encode(p)) for p in pieces(x)) if x else 0 for x in batch.pop("_text")])

    return count


ship(__name__)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Of each row its doc_id, source, lang (as strings), tokenizer version and n_tokens."""
    version, ranks = vocabulary(path, pattern)
    own = [F.col(c).cast("string").alias(n) for c, n in ((id_col, "doc_id"), (source, "source"), (lang, "lang"))]
    counted = docs.select(*own, F.col(text).alias("_text")).mapInPandas(counting(version, ranks, pattern), "doc_id string, source string, lang string, n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens")


class Rollups:
    """The ledger and rollups below a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, kind: str, batch: str) -> str:
        return f"{self.path}/{kind}/{quote(batch, safe='')}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(file)

    def committed(self) -> list[str]:
        """Folder names of the committed batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(top)]
        return sorted(x for x in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup/{x}/_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{x}" for x in self.committed()]
        # Names are escaped: the glob characters of a path are not among what quote() leaves.
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer version; those with nothing left are not given."""
        summed = self._read("rollup", ROLLUP).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs != 0 OR n_tokens != 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (op: insert, delete or revise; doc_id, source, lang, tokenizer, n_tokens) once. False: it was applied before."""
        if self._exists(f"{self._place('rollup', batch)}/_SUCCESS"):
            return False
        new = changes.filter("op = 'insert'").select(*[c.split()[0] for c in LEDGER.split(", ")[:-1]], F.lit(1).cast("long").alias("copies"))
        revised = changes.filter("op = 'revise'").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("source", "lang", "n_tokens")).alias("x"))
        revised = revised.select("doc_id", "x.source", "x.lang", "tokenizer", "x.n_tokens", F.lit(1).cast("long").alias("copies"))
        named = changes.filter("op IN ('delete', 'revise')").select(F.col("doc_id").alias("_doc"), F.col("tokenizer").alias("_version")).distinct()
        signed = new.unionByName(revised)
        if named.limit(1).count() and self.committed():
            named = grown(stored(named, "named"))
            held = self.ledger()
            back = held.join(named, held["doc_id"].eqNullSafe(F.col("_doc")) & held["tokenizer"].eqNullSafe(F.col("_version")), "left_semi")
            back = back.groupBy("doc_id", *KEYS, "n_tokens").agg((-F.sum("copies")).alias("copies")).filter("copies != 0")
            signed = signed.unionByName(back)
        at = self._place("ledger", batch)
        signed.write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema(LEDGER).parquet(at)
        rollup = rows.groupBy(*KEYS).agg(F.sum("copies").alias("n_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
        rollup.write.mode("overwrite").parquet(self._place("rollup", batch))
        return True
