"""The whole plan: pages to merged text, with a translator given as an expression or as rounds of attempts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TranslationOptions
from ..functions.once import with_once
from ..functions.text import is_blank, preprocess, sanitize_output
from ..operators import attempts, chunking, merging, validation

#: A native translator: text and language to output.
Translator = Callable[[Column, Column], Column]


def identity(text: Column, language: Column) -> Column:
    return text


def upper(text: Column, language: Column) -> Column:
    """ASCII letters in capitals: a stand-in that changes texts the same way on every engine."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def extract(pages: DataFrame) -> DataFrame:
    """doc_id, raw: the pages' texts in order, each followed by an empty line. A document's pages bound the list."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.concat_ws("", F.transform(ordered, lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit("\n\n")))).alias("raw"))


def reject_empty(docs: DataFrame, column: str = "raw") -> DataFrame:
    """Adds reason, which is null for documents with text."""
    return docs.withColumn("reason", F.when(is_blank(F.col(column)), "No text extracted; a scanned document needs OCR."))


@dataclass(frozen=True)
class Pipeline:
    """Replaceable parts; each is a DataFrame operator or an expression."""

    options: TranslationOptions = field(default_factory=TranslationOptions)
    chunker: chunking.Chunker | None = None
    translator: Translator = identity
    validate: Callable[..., Column] = validation.reason

    def chunks(self, pages: DataFrame) -> DataFrame:
        docs = reject_empty(extract(pages)).where("reason is null").select("doc_id", "raw")
        docs = with_once(docs, "raw", preprocess(F.col("raw")))
        return self.chunker(docs) if self.chunker else chunking.paragraph_chunks(docs, self.options.max_chars_per_chunk)

    def results(self, chunks: DataFrame) -> DataFrame:
        """One attempt by a native translator: a second would give the same output."""
        o = self.options
        done = with_once(chunks.withColumn("given", F.col("text")), "out", self.translator(F.col("text"), F.lit(o.target_language)))
        why = self.validate(F.col("given"), F.col("out"), o.min_output_chars, o.min_output_to_input_ratio)
        done = with_once(done, "why", why)
        good = F.col("why").isNull()
        return done.select(
            "doc_id", "chunk_index",
            F.when(good, "Success").otherwise("Quarantined").alias("status"),
            F.when(good, F.col("out")).alias("output"),
            F.when(~good, F.concat(F.lit("Validation failed: "), "why")).alias("error"),
            F.when(good, 1).otherwise(o.max_attempts_per_chunk).alias("attempts"),
        )

    def merged(self, results: DataFrame) -> DataFrame:
        merged = with_once(merging.merge_success(results), "merged", F.col("merged"))
        return merged.select("doc_id", sanitize_output(F.col("merged")).alias("merged"))

    def run(self, pages: DataFrame) -> DataFrame:
        return self.merged(self.results(self.chunks(pages)))


__all__ = ["Pipeline", "Translator", "attempts", "extract", "identity", "reject_empty", "upper"]
