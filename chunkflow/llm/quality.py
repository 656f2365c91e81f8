"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

Every passage of PASSAGE words is encoded by dense statistics and a small hashed bag of words, then by one tanh layer.
Gated attention (tanh times sigmoid) weighs the passages of a document, and the weighted mean is scored. Only document
labels are needed; the attention learns which passages decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import labelled_sample, remainder, table

#: Words of a passage; labelled documents that training uses at most; passes over them.
PASSAGE, SAMPLE, EPOCHS = 64, 6_000, 30
HIDDEN, GATE, BAG = 24, 12, 64
#: Byte classes that are counted in each passage.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\n", b".", b",", b"!?", b"|", b"#", b"$%&", b"*_~", b"<>{}[]()", b"\"'`", b":;-", b"=+/\\@^"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(CLASSES) + 1
WIDTH = len(CLASSES) + 2 + 7 + BAG


def passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of whole texts, and len(texts) + 1 offsets; a text without words is one zero row."""
    raws = words.encode(texts)
    data = b"\n".join(raws)
    h, offsets = words.hash_words(raws)
    n = np.diff(offsets)
    count = np.maximum(1, -(-n // PASSAGE))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    x = np.zeros((out_offsets[-1], WIDTH), np.float32)
    if not len(h):
        return x, out_offsets
    has = np.flatnonzero(n > 0)
    rows = np.concatenate([np.arange(out_offsets[i], out_offsets[i + 1]) for i in has])
    first = np.concatenate([np.arange(offsets[i], offsets[i + 1], PASSAGE) for i in has])
    last = np.append(first[1:], len(h))
    size = (last - first).astype(np.float64)
    starts, ends = words.word_spans(data)
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    begin, end = starts[first], ends[last - 1]
    length = (end - begin).astype(np.float64)
    cuts = np.concatenate([[0], np.stack([begin, end], 1).ravel(), [len(kinds)]])  # passages and what lies between them
    n_kinds = len(CLASSES) + 2
    flat = np.repeat(np.arange(len(cuts) - 1) * n_kinds, np.diff(cuts)) + kinds
    x[rows, :n_kinds] = 10 * np.bincount(flat, minlength=(len(cuts) - 1) * n_kinds).reshape(-1, n_kinds)[1::2] / length[:, None]
    which = np.repeat(np.arange(len(first)), last - first)
    at = len(CLASSES) + 2
    x[rows, at] = np.add.reduceat((ends - starts).astype(np.float64), first) / size / 8
    same = np.concatenate([[False], h[1:] == h[:-1]])
    x[rows, at + 1] = np.add.reduceat(same.astype(np.float64), first) / size
    key = words.mix(h ^ (which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    different = np.unique(key, return_index=True)[1]
    x[rows, at + 2] = np.bincount(which[different], minlength=len(first)) / size
    doc = np.repeat(np.arange(len(n)), n)
    seen = np.unique(words.mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    fresh = np.bincount(doc[seen], minlength=len(n)) / np.maximum(n, 1)
    owner = doc[first]
    x[rows, at + 3], x[rows, at + 4] = fresh[owner], np.log1p(n[owner]) / 5
    x[rows, at + 5] = np.add.reduceat(((ends - starts) > 20).astype(np.float64), first) / size
    x[rows, at + 6] = np.minimum(size / PASSAGE, 1)
    spot = which * BAG + (h & np.uint64(BAG - 1)).astype(np.int64)
    bag = np.bincount(spot, np.where(h >> np.uint64(63), 1.0, -1.0), len(first) * BAG)
    x[rows, at + 7 :] = bag.reshape(-1, BAG) / size[:, None]
    return x, out_offsets


class GatedAttention:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(3)
        init = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.mean, self.scale = mean, scale
        self.p = {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": np.zeros(GATE), "c": init(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, offsets: np.ndarray):
        p, at = self.p, offsets[:-1]
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(at)), np.diff(offsets))
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        m = np.add.reduceat(a[:, None] * h, at)
        return z, h, t, s, a, bag, m, 1 / (1 + np.exp(-(m @ p["c"] + p["d"])))

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.forward(x, offsets)[-1]

    def attention(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Weight of each passage; those of a document sum to 1."""
        return self.forward(x, offsets)[4]

    def gradients(self, x, offsets, y):
        p = self.p
        z, h, t, s, a, bag, m, out = self.forward(x, offsets)
        g = (out - y) / len(y)
        dm = g[:, None] * p["c"]
        dh = a[:, None] * dm[bag]
        da = (h * dm[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, offsets[:-1])[bag])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - h * h)
        return {"W": z.T @ dz, "b": dz.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": m.T @ g, "d": g.sum(keepdims=True)}

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray) -> GatedAttention:
        """Adam with small weight decay over shuffled batches of 64 documents; the same model for the same rows."""
        every = np.concatenate(bags)
        self = cls(every.mean(0), every.std(0) + 1e-3)
        rng, m, v, step = np.random.default_rng(4), {}, {}, 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            order = rng.permutation(len(bags))
            for i in range(0, len(order), 64):
                part = order[i : i + 64]
                sizes = [len(bags[k]) for k in part]
                g = self.gradients(np.concatenate([bags[k] for k in part]), np.concatenate([[0], np.cumsum(sizes)]), labels[part])
                step += 1
                for k, d in g.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def train_quality(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> GatedAttention | None:
    """Fits on at most SAMPLE labelled documents outside the held-out fold; None without two different labels.

    Passages are encoded by the executors; the driver gets their features, SAMPLE documents at most.
    """

    def encode(it):
        for f in it:
            for a, b in words.batches(f["text"].tolist()):
                x, offsets = passages(f["text"].tolist()[a:b])
                yield pd.DataFrame({"doc_id": f["doc_id"].iloc[a:b].to_numpy(), "label": f["label"].iloc[a:b].to_numpy(), "x": [x[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])]})

    sample = labelled_sample(docs, labels, "quality", mod, held, SAMPLE)
    got = sample.mapInPandas(encode, "doc_id long, label int, x binary").toPandas().sort_values("doc_id")
    if got["label"].nunique() < 2:
        return None
    return GatedAttention.fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got["x"]], got["label"].to_numpy(float))


def score_column(model: GatedAttention | None):
    """Score of a whole text; 0.5 without a model."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        parts = [model.score(*passages(texts[a:b])) if model else np.full(b - a, 0.5) for a, b in words.batches(texts)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run(F.col("text").cast("string"))


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted of every document.

    Null texts are empty texts and are scored too. Null ids are scored, not held out and not learnt from. Repeated rows
    are each scored. Labels, lang, source and doc_id are no inputs of a score; other columns are ignored.
    """
    score = score_column(train_quality(docs, labels, mod, held))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold."""
    return docs.where(score_column(train_quality(docs, labels)) >= threshold)


def op1_attention_mil_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
