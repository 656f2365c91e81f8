"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from the labelled rows: words, and word beginnings, whose share of toxic documents is far above
their share of others. Disguised spellings (digits and symbols for letters, marks inside words) are undone first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, labelled_sample, remainder, saved, table

#: Labelled documents that training uses at most.
SAMPLE = 8_000
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.15
#: Bytes of a word's beginning that the second lexicon knows.
STEM = 5
#: Signs that stand for letters in disguised spellings, and marks that are left out.
_LOOKS = bytes.maketrans(b"013457@$ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastasabcdefghijklmnopqrstuvwxyz")
_MARKS = b".,;:!?\"'()[]{}<>*_-~^`|/\\#%&+="
#: Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros".split()
_PERSON = None
FEATURES = 14


def _words(texts):
    """Hashes of undisguised words and of their beginnings, offsets, and which words were disguised."""
    raws = [r.translate(_LOOKS, _MARKS) for r in words.encode(texts)]
    h, offsets = words.hash_words(raws)
    data = b"\n".join(raws)
    starts, ends = words.word_spans(data)
    buf = np.frombuffer(data + b"\0" * STEM, np.uint8)
    stem = np.zeros(len(starts), np.uint64)
    for i in range(STEM):
        stem = stem * np.uint64(257) + buf[starts + i] if len(starts) else stem
    return h, words.mix(stem) * ((ends - starts) > STEM + 1), offsets


class Lexicon:
    """Sorted hashes of words and of beginnings, with their log odds.

    tables: for words, then for beginnings, the hashes that occur in documents and in how many toxic and other ones.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], toxic: int, others: int):
        self.tables = []
        least = max(3, int(0.006 * max(1, toxic)))
        for u, t, c in tables:
            order = np.argsort(u)
            u, t, c = u[order], t[order], c[order]
            odds = np.log((t + 0.5) / (max(1, toxic) + 1)) - np.log((c + 0.5) / (max(1, others) + 1))
            surely = odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))  # lower end of the log odds
            pick = (t >= least) & (surely > 0.8) & (u != 0)
            self.tables.append((u[pick], odds[pick]))

    def weigh(self, h: np.ndarray, side: int) -> np.ndarray:
        u, odds = self.tables[side]
        if not len(u) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(u, h), len(u) - 1)
        return np.where(u[at] == h, odds[at], 0.0)


def bag_of(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    h, stems, offsets = _words(texts)
    return [(np.unique(h[a:b]), np.unique(stems[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]


def features(texts, lexicon: Lexicon) -> np.ndarray:
    """FEATURES numbers of each whole text."""
    global _PERSON
    if _PERSON is None:
        _PERSON = np.sort(words.hash_words([w.encode() for w in SECOND_PERSON])[0])
    h, stems, offsets = _words(texts)
    n = np.diff(offsets)
    out = np.zeros((len(texts), FEATURES))
    doc = np.repeat(np.arange(len(n)), n)
    size = np.maximum(n, 1)
    total = lambda x: np.bincount(doc, x, len(n))
    word, stem = lexicon.weigh(h, 0), lexicon.weigh(stems, 1)
    hit, part = word > 0, stem > 0
    for k, (w, on) in enumerate(((word, hit), (stem, part))):
        out[:, 3 * k] = total(on)
        out[:, 3 * k + 1] = 100 * total(w) / size
        np.maximum.at(out[:, 3 * k + 2], doc, w)
    either = hit | part
    if either.any():
        spot = np.flatnonzero(either)
        key = words.mix(h[spot] ^ (doc[spot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        first = np.unique(key, return_index=True)[1]
        out[:, 6] = np.bincount(doc[spot[first]], minlength=len(n))
        person = np.flatnonzero(np.isin(h, _PERSON))
        if len(person):
            at = np.clip(np.searchsorted(person, spot), 1, len(person) - 1) if len(person) > 1 else np.zeros(len(spot), np.int64)
            for q in (person[at], person[np.maximum(at - 1, 0)]):
                near = np.where(doc[q] == doc[spot], 1 / (1 + np.abs(q - spot)), 0)
                np.maximum.at(out[:, 7], doc[spot], near)
    plain, raws = words.hash_words(words.encode(texts))[1], words.encode(texts)
    for i, r in enumerate(raws):
        size_b = max(1, len(r))
        letters = len(r) - len(r.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out[i, 8] = letters / size_b
        out[i, 9] = (r.count(b"!") + r.count(b"?")) / size_b
        out[i, 10] = (len(r) - len(r.translate(None, _MARKS))) / size_b
        out[i, 11] = (len(r) - len(r.translate(None, b"013457@$*"))) / size_b
    out[:, 12] = np.log1p(np.diff(plain))
    out[:, 13] = 100 * out[:, 6] / size
    return out


class Trees:
    """Boosted regression trees of depth DEPTH on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.bins(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees, f = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._apply(tree, b)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def _grow(self, b, g, w):
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        node = np.zeros(len(b), np.int64)
        for level in range(DEPTH):
            for k in range(2**level):
                here = np.flatnonzero(node == k)
                best = 1e-6
                if len(here) >= 20:
                    for j in range(b.shape[1]):
                        gs, ws, ns = (np.cumsum(np.bincount(b[here, j], v, BINS))[:-1] for v in (g[here], w[here], None))
                        gt, wt = g[here].sum(), w[here].sum()
                        gain = gs**2 / (ws + 1) + (gt - gs) ** 2 / (wt - ws + 1) - gt**2 / (wt + 1)
                        gain = np.where((ns >= 8) & (len(here) - ns >= 8), gain, 0)
                        if gain.max() > best:
                            best, feature[2**level - 1 + k], cut[2**level - 1 + k] = gain.max(), j, gain.argmax()
            at = 2**level - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[at]] > cut[at])
        leaf = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, w, 2**DEPTH) + 1)
        return feature, cut, leaf

    def _apply(self, tree, b):
        feature, cut, leaf = tree
        node = np.zeros(len(b), np.int64)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[at]] > cut[at])
        return leaf[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + sum(self._apply(t, b) for t in self.trees)


class Isotonic:
    """Non-decreasing fit of labels to raw scores by pooling adjacent violators; linear in the gaps between blocks.

    Equal raw scores are one block from the start, so the order of rows does not matter.
    """

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        different, back, count = np.unique(raw, return_inverse=True, return_counts=True)
        blocks: list[list[float]] = []  # first and last raw score, sum of labels, rows
        for r, t, n in zip(different.tolist(), np.bincount(back, y, len(different)).tolist(), count.tolist()):
            blocks.append([r, r, t, n])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                _, last, t2, n2 = blocks.pop()
                first, _, t1, n1 = blocks[-1]
                blocks[-1] = [first, last, t1 + t2, n1 + n2]
        self.x = np.array([x for b in blocks for x in b[:2]])
        self.y = np.array([b[2] / b[3] for b in blocks for _ in "xx"])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


class Toxicity:
    """Trees and calibration over the features of labelled documents.

    x: for each document its features by a lexicon that was learnt without its fold, fold: 0 or 1. Raw scores of each
    fold come from the other's trees and calibrate; the trees in use are fitted on all rows.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, lexicon: Lexicon):
        raw = np.zeros(len(x))
        for k in (0, 1):
            raw[fold == k] = Trees(x[fold != k], labels[fold != k]).raw(x[fold == k])
        self.calibrate, self.trees, self.lexicon = Isotonic(raw, labels), Trees(x, labels), lexicon

    def score(self, texts) -> np.ndarray:
        return self.calibrate(self.trees.raw(features(texts, self.lexicon)))


def _documents(f: pd.DataFrame):
    """Pieces of a frame whose texts together are not long."""
    for a, b in words.batches(f["text"].tolist()):
        yield f.iloc[a:b]


def _bags(it):
    """fold, side (0 words, 1 beginnings), hash, toxic, once for each document that has it."""
    for f in it:
        for part in _documents(f):
            bags = bag_of(part["text"].tolist())
            for side in (0, 1):
                n = [len(b[side]) for b in bags]
                yield pd.DataFrame({"fold": np.repeat(part["fold"].to_numpy(), n), "side": side, "h": np.concatenate([b[side] for b in bags]).view(np.int64), "toxic": np.repeat(part["label"].to_numpy(), n)})


def train_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> Toxicity | None:
    """Fits on at most SAMPLE labelled documents outside the held-out fold; None without enough of both labels.

    The executors count words and work out features; the driver gets the words of the lexicon and FEATURES numbers of
    each document, no texts.
    """
    sample = labelled_sample(docs, labels, "toxic", mod, held, SAMPLE)
    key = F.xxhash64("text", F.lit(9))
    sample = sample.groupBy(key.alias("key")).agg(F.min(F.struct("doc_id", "text", "label")).alias("r")).select("r.*", F.pmod("key", F.lit(2)).cast("int").alias("fold"))
    sample = saved(sample, "sample")  # equal texts count once
    sizes = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    count = lambda label, folds=(0, 1): sum(sizes.get((k, label), 0) for k in folds)
    if min(sizes.get((k, y), 0) for k in (0, 1) for y in (0, 1)) < 2:
        discard(sample)
        return None
    seen = sample.mapInPandas(_bags, "fold int, side int, h long, toxic int").groupBy("side", "h")
    seen = seen.agg(*(F.count_if((F.col("fold") == k) & (F.col("toxic") == y)).alias(f"n{k}{y}") for k in (0, 1) for y in (0, 1))).where("n01 + n11 >= 3")
    got = seen.toPandas()  # words of three toxic documents of the sample at least

    def lexicon(folds):
        t, c = (got[[f"n{k}{y}" for k in folds]].sum(axis=1).to_numpy() for y in (1, 0))
        side = got["side"].to_numpy()
        tables = [(got["h"].to_numpy()[side == s].view(np.uint64), t[side == s], c[side == s]) for s in (0, 1)]
        return Lexicon(tables, count(1, folds), count(0, folds))

    of_others = [lexicon([1]), lexicon([0])]

    def encode(it):
        for f in it:
            for part in _documents(f):
                for k in (0, 1):
                    own = part[part["fold"] == k]
                    if len(own):
                        x = features(own["text"].tolist(), of_others[k])
                        yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "label": own["label"].to_numpy(), "fold": k, "x": list(x)})

    rows = sample.mapInPandas(encode, "doc_id long, label int, fold int, x array<double>").toPandas().sort_values("doc_id")
    discard(sample)
    return Toxicity(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(float), rows["fold"].to_numpy(), lexicon([0, 1]))


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (higher: toxic likelier) and predicted of every document.

    Null texts are empty texts and are scored too; all scores are 0 without enough labels. Null ids are scored, not held
    out and not learnt from. Repeated rows are each scored. Labels, lang, source and doc_id are no inputs of a score;
    other columns are ignored.
    """
    model = train_toxicity(docs, labels, mod, held)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        parts = [model.score(texts[a:b]) if model else np.zeros(b - a) for a, b in words.batches(texts)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
