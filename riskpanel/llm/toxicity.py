"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is its lower-cased words. A word's input is an embedding of the word, the sum of embeddings of its
character 4-grams, and the largest 4-gram weight; both embeddings start from how much oftener toxic
texts of the sample have the word or 4-gram, and are trained with the rest. The network reads windows of
WINDOW words, each starting STEP words after the one before, from both ends; attention pools its states;
the text's score is that of its highest window. Labels are per text, so a toxic text trains the
network by its highest window only, and others by their highest windows and some more.

The network is trained in numpy on a bounded sample: at most SAMPLE rows of each label of at most SAMPLE_CHARS
characters each, those of least hash of their id. All windows of all whole texts are scored.

Defined results: a text without words (null or empty too) scores 0; without rows of both labels to learn
from, all texts score 0; repeated rows each get a score; labelled rows with a null id or label, or whose id no
document has, teach nothing; of an id with both labels the label is 1; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grown, ship, stored

SAMPLE, SAMPLE_CHARS = 1500, 20_000
WINDOW, STEP, HIDDEN, SIZE = 64, 32, 12, 8
WORDS, GRAMS, LEAST_TEXTS = 4000, 8000, 4
EPOCHS, BATCH, RATE = 12, 128, 0.004
#: Words whose inputs a worker keeps.
KEPT_WORDS = 200_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + 4] for i in range(max(1, len(padded) - 3))]


def weights_of(texts: list[set[str]], labels: np.ndarray, most: int) -> dict[str, float]:
    """Log ratios of how often toxic and other texts have each item, shrunk for rare ones; the most telling."""
    here = [Counter(), Counter()]
    for items, y in zip(texts, labels, strict=True):
        here[y].update(items)
    n = np.bincount(labels, minlength=2)
    found = {}
    for item in here[1].keys() | here[0].keys():
        a, b = here[1][item], here[0][item]
        if a + b >= LEAST_TEXTS:
            found[item] = float(np.log((a + 0.5) / (n[1] + 1) * (n[0] + 1) / (b + 0.5)) * (a + b) / (a + b + 5))
    top = sorted(found, key=lambda x: (-abs(found[x]) * min(here[1][x] + here[0][x], 50) ** 0.5, x))[:most]
    return {x: found[x] for x in sorted(top)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Vocabularies and parameters. Row 0 of each embedding stands for all other items and stays 0."""

    def __init__(self, words: dict[str, float], grams: dict[str, float], seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.words, self.grams = ({x: i + 1 for i, x in enumerate(v)} for v in (words, grams))
        self.p: dict[str, np.ndarray] = {"ew": draw(len(words) + 1, SIZE, scale=0.05), "ec": draw(len(grams) + 1, SIZE, scale=0.05)}
        for name, v in (("ew", words), ("ec", grams)):
            self.p[name][0] = 0
            self.p[name][1:, 0] = np.fromiter(v.values(), np.float32, len(v)) / (3 if name == "ew" else 6)
        self.top = np.concatenate([[0], np.fromiter(grams.values(), np.float32, len(grams))]).astype(np.float32) / 3
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * SIZE + 1, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"v": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.kept: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}, "inputs": None}

    def items(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding row of each word; rows of all its 4-grams, and where each word's begin."""
        get, ids, begins = self.grams.get, [], []
        for w in words:
            begins.append(len(ids))
            ids += [get(g, 0) for g in grams_of(w)]
        return np.array([self.words.get(w, 0) for w in words], np.int64), np.array(ids, np.int64), np.array(begins, np.int64)

    def input_rows(self, items: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        own, ids, begins = items
        if not len(own):
            return np.zeros((0, 2 * SIZE + 1), np.float32)
        return np.concatenate([self.p["ew"][own], np.add.reduceat(self.p["ec"][ids], begins), np.maximum.reduceat(self.top[ids], begins)[:, None]], axis=1)

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: inputs times w, (time, windows, 3 * HIDDEN). Hidden states in the order of time; keep gets what backward needs."""
        u, n = self.p[f"u{d}"], HIDDEN
        h, out = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape[:2], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            zr = sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
            new = c + z * (h - c)
            new *= mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * n :]))
            h = out[t] = new
        return out

    def pooled(self, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = h @ self.p["v"]
        e = np.exp(np.where(mask > 0, e - e.max(axis=0), -30)) * mask
        a = e / (e.sum(axis=0) + 1e-12)
        return (a[:, :, None] * h).sum(axis=0), a

    def logits(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """windows: rows of table, -1 where there is no word; table: inputs by word."""
        out = []
        xs = {d: np.concatenate([table @ self.p[f"w{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}
        for at in range(0, len(windows), 2048):
            own = windows[at : at + 2048].T
            mask = (own >= 0).astype(np.float32)
            h = np.concatenate([self.states(xs[d][own], mask, d) for d in "fb"], axis=2)
            out.append(self.pooled(h, mask)[0] @ self.p["o"] + self.p["k"][0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, items: tuple, windows: np.ndarray, y: np.ndarray, drop: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients; drop: words whose own embedding is left out this time."""
        own, ids, begins = items
        own = np.where(drop, 0, own)
        table = self.input_rows((own, ids, begins))
        windows = windows.T
        mask = (windows >= 0).astype(np.float32)
        x = table[windows] * mask[:, :, None]
        keep: dict[str, list] = {"f": [], "b": []}
        n, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        h = np.concatenate([self.states(x @ self.p[f"w{d}"] + self.p[f"c{d}"], mask, d, keep[d]) for d in "fb"], axis=2)
        pool, a = self.pooled(h, mask)
        logit = pool @ self.p["o"] + self.p["k"][0]
        s = sigmoid(logit)
        loss = float(-(y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7)).mean())
        dl = ((s - y) / len(y)).astype(np.float32)
        g["o"], g["k"] = dl @ pool, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.p["o"]
        da = (h * dp).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, h)
        dh = a[:, :, None] * dp + de[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u, w = self.p[f"u{d}"], self.p[f"w{d}"]
            back = np.zeros((len(y), n), np.float32)
            for t, before, z, r, c, hn in reversed(keep[d]):
                back = (back + dh[t, :, i * n : (i + 1) * n]) * mask[t][:, None]
                dc = back * (1 - z) * (1 - c * c)
                dz = back * (before - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                dx3 = np.concatenate([dz, dr, dc], axis=1)
                du3 = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"w{d}"] += x[t].T @ dx3
                g[f"c{d}"] += dx3.sum(axis=0)
                g[f"u{d}"] += before.T @ du3
                dx[t] += dx3 @ w.T
                back = back * z + du3 @ u.T
        dtable = np.zeros_like(table)
        here = windows >= 0
        np.add.at(dtable, windows[here], dx[here])
        np.add.at(g["ew"], own, dtable[:, :SIZE])
        np.add.at(g["ec"], ids, np.repeat(dtable[:, SIZE : 2 * SIZE], np.diff([*begins, len(ids)]), axis=0))
        g["ew"][0] = g["ec"][0] = 0
        return loss, g

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each whole text: that of its highest window."""
        if not len(self.kept):
            self.inputs = np.zeros((0, 2 * SIZE + 1), np.float32)
        out = np.zeros(len(texts))
        rows: list[np.ndarray] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                kept = self.kept
                own = np.array([kept.setdefault(w, len(kept)) for w in words], np.int64)
                rows.append(windows_of(own))
                owner += [i] * len(rows[-1])
        if rows:
            new = list(self.kept)[len(self.inputs) :]
            self.inputs = np.concatenate([self.inputs, self.input_rows(self.items(new))])
            np.maximum.at(out, np.array(owner), sigmoid(self.logits(self.inputs, np.concatenate(rows)).astype(float)))
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        return out


def windows_of(words: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text's words, the last one filled up with -1."""
    n = max(1, -(-(len(words) - WINDOW) // STEP) + 1)
    padded = np.full((n - 1) * STEP + WINDOW, -1, np.int64)
    padded[: len(words)] = words
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network | None:
    """A network from labelled texts; None if there aren't texts of both labels."""
    words = [words_of(t) for t in texts]
    some = [i for i, w in enumerate(words) if w]
    words, y = [words[i] for i in some], np.asarray(labels, np.int64)[some]
    if len(set(y.tolist())) < 2:
        return None
    sets = [set(w) for w in words]
    net = Network(weights_of(sets, y, WORDS), weights_of([{g for w in s for g in grams_of(w)} for s in sets], y, GRAMS), seed)
    names: dict[str, int] = {}
    views = [windows_of(np.array([names.setdefault(w, len(names)) for w in ws], np.int64)) for ws in words]
    every, owner = np.concatenate(views), np.repeat(np.arange(len(views)), [len(v) for v in views])
    items = net.items(list(names))
    r = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    table = net.input_rows(items)
    # Before the network knows anything, a window's highest word and 4-gram weights rank it.
    first = np.where(every >= 0, (table[:, 0] + table[:, 2 * SIZE])[every], -9).max(axis=1)
    for epoch in range(epochs):
        rank = first if not epoch else net.logits(net.input_rows(items), every)
        order = np.lexsort((-rank, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        toxic = y[owner[order]] == 1
        chosen = order[(toxic & (place < 1)) | (~toxic & ((place < 2) | (r.random(len(order)) < 0.1)))]
        share = y[owner[chosen]].mean()
        chosen = np.concatenate([chosen, *[chosen[y[owner[chosen]] == 1]] * min(3, int(0.5 / max(share, 0.01)) - 1)])
        r.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            own = chosen[at : at + BATCH]
            here, local = np.unique(every[own], return_inverse=True)
            local = local.reshape(every[own].shape) - (here[0] < 0)
            here = here[here >= 0]
            lengths = np.diff([*items[2], len(items[1])])[here]
            ends = np.cumsum(lengths)
            grams = items[1][np.repeat(items[2][here] - (ends - lengths), lengths) + np.arange(ends[-1])]
            _, g = net.gradients((items[0][here], grams, ends - lengths), local, y[owner[own]], r.random(len(here)) < 0.3)
            step += 1
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                net.p[k] -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def scoring(net: Network | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("_text").to_list()
            found, begin, size = [np.zeros(0)], 0, 0
            for i, x in enumerate([*texts, None]):  # about a megabyte of text at a time
                size += len(x or "")
                if i == len(texts) or size > 1 << 20:
                    end = min(i + 1, len(texts))
                    found.append(net.scores(texts[begin:end]) if net else np.zeros(end - begin))
                    begin, size = end, 0
            yield batch.assign(score=np.concatenate(found))

    return score


ship(__name__)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, rows: int, chars: int) -> tuple[list[str], np.ndarray]:
    """At most rows texts of each label, of ids that aren't held out and at most chars characters: those of least hash among all that have a label."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)").filter(~held_out("_id"))
    own = own.groupBy("_id").agg(F.max("_y").alias("_y"))
    short = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).filter(F.length("_text") <= chars)
    # Ids are chosen among those that documents have; texts are read for the chosen ones only, which are rows at most.
    labelled = stored(short.select("_id").join(grown(own), "_id").distinct(), "labelled")
    order = [F.xxhash64("_id"), F.col("_id")]
    texts, y = [], []
    for value in (0, 1):
        ids = F.broadcast(labelled.filter(F.col("_y") == value).select("_id").orderBy(*order).limit(rows))
        found = short.join(ids, "_id").orderBy(*order, "_text").limit(rows).collect()
        texts += [r["_text"] for r in found]
        y += [value] * len(found)
    return texts, np.array(y, np.int64)


def held_out(id_col: str):
    """Whether a row's label is never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """id, held_out, score and predicted (1 if score is 0.5 or more, else 0) of each row of docs."""
    net = train(*sample(docs, labels, id_col, text, label, rows, chars))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInPandas(scoring(net), f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
