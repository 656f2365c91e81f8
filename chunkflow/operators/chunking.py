"""Chunkers: each is a row-local expression over a document's text, so no chunker shuffles."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, is_blank, trim, utf16_length


class Chunker(Protocol):
    """Documents with a text to chunks: doc_id, chunk_index (from 0, dense), text."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs, trimmed."""
    return F.filter(F.transform(F.split(text, "\n\n", -1), trim), lambda p: p != "")


def pack_paragraphs(text: Column, limit: int) -> Column:
    """Texts of at most `limit` UTF-16 units, greedily joined from paragraphs by an empty line.

    A longer paragraph is cut into sentences that are packed with spaces; its chunks hold nothing else. A longer
    sentence is a chunk by itself.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    unit = lambda x, big, p: F.struct(x.alias("x"), F.lit(big).alias("big"), p.alias("p"), utf16_length(x).alias("n"))
    sentences = lambda p: F.split(p, rf"(?<=[.!?]){WS}+", -1)
    units = F.flatten(F.transform(paragraphs(text), lambda p, i: F.when(utf16_length(p) > limit, F.transform(sentences(p), lambda s: unit(s, True, i))).otherwise(F.array(unit(p, False, i)))))
    gap = lambda big: F.when(big, " ").otherwise("\n\n")
    state = lambda starts, n, at: F.struct(starts.alias("starts"), n.alias("n"), at.alias("at"))

    def chunks(us: Column) -> Column:
        """The places where chunks start come first, from lengths alone; then the units between them are joined."""

        def step(s: Column, u: Column) -> Column:
            before = F.element_at(us, s["at"])  # the unit before this one, counted from 1
            n = s["n"] + F.length(gap(u["big"])) + u["n"]
            fits = (s["at"] > 0) & (before["big"] == u["big"]) & (~u["big"] | (before["p"] == u["p"])) & (n <= limit)
            here = s["at"] + 1
            return F.when(fits, state(s["starts"], n, here)).otherwise(state(F.concat(s["starts"], F.array(here)), u["n"], here))

        start = state(F.array().cast("array<int>"), F.lit(0), F.lit(0))
        starts = F.aggregate(us, start, step, lambda s: s["starts"])

        def cut(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(us) + 1), F.array(F.size(us) + 1))
            texts = lambda a, e: F.transform(F.slice(us, a, e - a), lambda u: u["x"])
            joined = lambda a, e: F.when(F.element_at(us, a)["big"], F.array_join(texts(a, e), " ")).otherwise(F.array_join(texts(a, e), "\n\n"))
            return F.zip_with(at, ends, lambda a, e: F.when(a.isNotNull(), joined(a, e)))

        return F.transform(F.array(starts), lambda at: F.filter(cut(at), lambda c: ~is_blank(c)))[0]

    return F.transform(F.array(units), chunks)[0]


def pack_words(text: Column, size: int) -> Column:
    """Groups of `size` words joined by a space."""
    if size <= 0:
        raise ValueError("size must be positive")
    words = F.filter(F.split(text, rf"{WS}+", -1), lambda w: w != "")

    def groups(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))
        return F.when(F.size(w) > 0, parts).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), groups)[0]  # the text is split once, not once for each group


def _exploded(docs: DataFrame, chunks: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))


def paragraph_chunks(docs: DataFrame, limit: int, column: str = "raw") -> DataFrame:
    return _exploded(docs, pack_paragraphs(F.col(column), limit))


def word_chunks(docs: DataFrame, size: int, column: str = "raw") -> DataFrame:
    return _exploded(docs, pack_words(F.col(column), size))


def select_chunks(chunks: DataFrame, wanted: list[int] | None) -> DataFrame:
    """The wanted chunks of every document, in the order of the list and numbered anew; duplicates are allowed.

    No list: all chunks. A document that lacks one of them has no rows. A negative index is an error, once a document
    has all the others.
    """
    if not wanted:
        return chunks
    if max(wanted) < 0:
        raise IndexError("negative chunk index")
    listed = F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(i).alias("i")) for p, i in enumerate(wanted))))
    plan = chunks.sparkSession.range(1).select(listed.alias("w")).select("w.pos", "w.i")
    enough = chunks.groupBy("doc_id").agg(F.max("chunk_index").alias("top")).where(F.col("top") >= max(wanted)).select("doc_id")
    if min(wanted) < 0:
        return chunks.join(enough, "doc_id", "left_semi").select("doc_id", "chunk_index", F.coalesce(F.raise_error(F.lit("negative chunk index")).cast("string"), "text").alias("text"))
    some = chunks.where(F.col("chunk_index").isin(list(set(wanted)))).join(F.broadcast(plan), F.col("i") == F.col("chunk_index"))
    return some.join(enough, "doc_id", "left_semi").select("doc_id", F.col("pos").alias("chunk_index"), "text")
