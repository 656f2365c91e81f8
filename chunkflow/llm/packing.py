"""Packing documents into bins of fixed capacity: best fit under conflicts.

No bin holds two documents of one source or two of one cluster of near copies. Documents are dealt into groups by a
hash, or by ranges of the slots of a mix; each group is packed by itself, larger documents first. Open bins are kept by residual, and bins of one residual
by the bitmap of their sources (and of the group's frequent clusters); a bitmap of its repeated clusters goes with each
bin. The search takes the successor of the document's size among the residuals and goes on until a bin is compatible,
so the bin found is the tightest compatible one.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, settled, table
from .near_dup import near_duplicates
from .token_files import CHARS, encoder
from .words import ranges

#: Tokens a bin holds, bytes a token (where pack() estimates), documents of a group.
CAPACITY, TOKEN_BYTES, GROUP = 2_048, 4, 8_000
#: Slots of a mix whose documents are never dealt to different groups; a slot holds a few documents.
SLOTS = 1_000
#: A cluster with so many documents in a group is part of the key by which bins are looked up.
FREQUENT = 32


class Bins:
    def __init__(self, capacity: int, classes: int):
        self.capacity, self.residual, self.sig, self.rare = capacity, [], [], []
        self.at: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(capacity + 1)]
        self.total = np.zeros(capacity + 1, np.int32)
        self.holding = np.zeros((classes, capacity + 1), np.int32)

    def find(self, size: int, classes: list[int], rare: int) -> int:
        """The tightest bin with room for size, without the classes and the repeated cluster's bit; -1 if none."""
        free = self.total[size:].copy()
        for c in classes:
            np.minimum(free, self.total[size:] - self.holding[c, size:], out=free)
        mask = sum(1 << c for c in classes)
        for r in np.flatnonzero(free > 0) + size:
            for sig, bins in self.at[r].items():
                if not sig & mask:
                    for b in reversed(bins):
                        if not self.rare[b] & rare:
                            return b
        return -1

    def _move(self, b: int, by: int):
        r, sig = self.residual[b], self.sig[b]
        self.total[r] += by
        for c in _ones(sig):
            self.holding[c, r] += by
        if by > 0:
            self.at[r][sig].append(b)
        else:
            self.at[r][sig].remove(b)
            if not self.at[r][sig]:
                del self.at[r][sig]

    def put(self, b: int, size: int, classes: list[int], rare: int) -> tuple[int, int]:
        """Adds to bin b, or to a new one for -1: (bin, offset)."""
        if b < 0:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sig.append(0)
            self.rare.append(0)
        elif self.residual[b]:
            self._move(b, -1)
        offset = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.sig[b] |= sum(1 << c for c in classes)
        self.rare[b] |= rare
        if self.residual[b]:
            self._move(b, 1)
        return b, offset


def _ones(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces are placed in the given order. None as source or cluster conflicts with none."""
    class_of = {s: i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    often = Counter(c for c in clusters if c is not None)
    hot_of = {c: len(class_of) + i for i, c in enumerate(c for c, n in often.items() if n >= FREQUENT)}
    rare_of = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if 1 < n < FREQUENT)}
    bins, out = Bins(capacity, len(class_of) + len(hot_of)), []
    for size, s, c in zip(sizes, sources, clusters):
        classes = ([] if s is None else [class_of[s]]) + ([hot_of[c]] if c in hot_of else [])
        rare = rare_of.get(c, 0)
        out.append(bins.put(bins.find(size, classes, rare), size, classes, rare))
    return out


def estimated(docs: DataFrame, cluster: Column | None = None) -> DataFrame:
    """What packing needs of each document: doc_id, source, cluster and n, by the size of the text."""
    cluster = F.xxhash64("text") if cluster is None else cluster
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(text != "", cluster).cast("string").alias("cluster"), (F.ceil(F.octet_length(text) / TOKEN_BYTES) + 1).cast("long").alias("n"))


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, n_tokens, bin, offset.

    A document has a token for every TOKEN_BYTES bytes of its text, and an end token; one that is longer than a bin is
    cut into full pieces and a rest. cluster: the documents' duplicate cluster (default: equal texts). Null or empty
    text is the end token alone and is in no cluster; a null source conflicts with none. Rows that repeat an id are
    packed each. Null ids are packed. Other columns are ignored.
    """
    return pack_sized(saved(estimated(docs, cluster), "sizes"), capacity)


def pack_sized(rows: DataFrame, capacity: int = CAPACITY, slot: str | None = None) -> DataFrame:
    """Like pack(), of rows (doc_id, source, cluster, n) with n tokens each.

    slot: the column that holds the documents' slots in a mix. Groups are then ranges of slots, about GROUP documents
    each, and bins are numbered in the order of their first slots, so that reading bin by bin follows the mix.
    """
    d = rows.select("doc_id", "source", "cluster", "n", (F.lit(0) if slot is None else F.coalesce(slot, F.lit(0))).cast("long").alias("slot"))
    if slot is None:
        groups = max(1, -(-d.count() // GROUP))
        d = d.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster", "n"), F.lit(groups)))
    else:
        d = saved(d.withColumn("part", F.floor(F.col("slot") / SLOTS)), "slots")
        before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = d.groupBy("part").count().select("part", F.floor(before / GROUP).alias("grp"))  # a row for about GROUP documents
        d = d.join(parts, "part").drop("part")
    d = d.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids beside nulls

    def run(key, f):
        f = f.sort_values(["n", "doc_id", "cluster"], ascending=[False, True, True])
        full, rest = f["n"].to_numpy() // capacity, f["n"].to_numpy() % capacity
        n = full + (rest > 0)
        row = np.repeat(np.arange(len(f)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        size = np.where(piece < full[row], capacity, rest[row])
        order = np.lexsort((row, -size))
        take = lambda c: f[c].astype(object).where(f[c].notna(), None).to_numpy()[row][order].tolist()
        placed = pack_group(size[order].tolist(), take("source"), take("cluster"), capacity)
        bins = np.array([b for b, _ in placed], np.int64)
        if slot is not None:
            first = np.full(bins.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, bins, f["slot"].to_numpy()[row][order])
            bins = np.argsort(np.argsort(first, kind="stable"))[bins]
        return pd.DataFrame({"doc_id": pd.array([x if x is None else int(x) for x in take("doc_id")], "Int64"), "piece": piece[order], "n_tokens": size[order], "bin": int(key[0]) * 2**32 + bins, "offset": [o for _, o in placed]})

    return d.groupBy("grp").applyInPandas(run, "doc_id long, piece long, n_tokens long, bin long, offset long")


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per document, without its text: row (hash of id and text), doc_id, source, same (hash of the text; null
    without one) and n, the ids of the whole text as write_token_files() writes them, and the end id.

    The default tokenizer is op 4's, read from its file of ranks.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    d = docs.select(_row(), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.col("text") != "", F.xxhash64("text")).alias("same"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("same", pa.int64()), ("n", pa.int64())])

    def run(it):
        for batch in it:
            texts = batch.column(4)
            for a, b in ranges(pc.binary_length(texts).to_pylist(), CHARS):
                n = pa.array(encoder(path).count(texts.slice(a, b - a)) + 1, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), n], schema=schema)

    return d.mapInArrow(run, "row long, doc_id long, source string, same long, n long")


def _row() -> Column:
    """Tells rows apart by id and text, so that null ids and repeated ids are compared too."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row")


def sizes_and_copies(docs: DataFrame) -> DataFrame:
    """What packing needs of each document (doc_id, source, text): doc_id, source, cluster and n, by counted tokens.

    cluster is the near-duplicate component; equal texts where there are no words; null without a text.
    """
    found = near_duplicates(docs.select(_row().alias("doc_id"), "text")).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    cluster = F.coalesce(F.concat(F.lit("~"), F.col("component").cast("string")), F.concat(F.lit("="), F.col("same").cast("string")))
    sizes = lambda: saved(counted(docs), "counts").join(found, "row", "left").select("doc_id", "source", cluster.alias("cluster"), "n")
    return settled(docs.sparkSession, sizes, "sizes")


def op2_conflict_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_sized(sizes_and_copies(table(spark, sf_dir, "documents")))
