"""Results in order: merged text, review report, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def _joined(value: Column, gap: str) -> Column:
    """Values of a document in chunk order; a document's own text bounds the list."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", value.alias("v")))), lambda x: x["v"]), gap)


def _good() -> Column:
    return (F.col("status") == "Success") & ~is_blank(F.col("output"))


def merge_success(results: DataFrame) -> DataFrame:
    """doc_id and the outputs of its successful chunks, joined by an empty line."""
    return results.where(_good()).groupBy("doc_id").agg(_joined(F.col("output"), "\n\n").alias("merged"))


def review_report(results: DataFrame) -> DataFrame:
    """doc_id and the report of its other chunks; documents without such chunks have no row."""
    head = F.format_string("----- CHUNK %05d (%s) -----\n", F.col("chunk_index"), F.col("status"))
    error = F.when(is_blank(F.col("error")), "").otherwise(F.concat(F.col("error"), F.lit("\n")))
    return results.where(~F.coalesce(_good(), F.lit(False))).groupBy("doc_id").agg(_joined(F.concat(head, error, F.lit("\n")), "").alias("report"))


def status_summary(results: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return results.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), *(count(s) for s in ("Success", "Quarantined", "Failed")))
