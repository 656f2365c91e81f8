"""Sinks: text and PDF files, one for each document; atomic files; the review report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FontOptions
from ..operators.layout import styled
from ..operators.merging import review_report
from ..operators.structure import blocks
from .files import write_atomic
from .pdf import documents


def named(df: DataFrame, suffix: str) -> DataFrame:
    """Adds name, a document's file: its id's last path part without extension, made safe, and the suffix.

    Where several ids would share a name (on some file systems, without regard to case), each gets a hash of its id.
    """
    stem = F.regexp_replace(F.regexp_extract(F.col("doc_id").cast("string"), r"([^/\\]*)\z", 1), r"\.[A-Za-z0-9]{1,5}\z", "")
    d = df.withColumn("name", F.regexp_replace(stem, r"(?U)[^\w.\-]", "_"))
    several = d.select(F.lower("name").alias("low"), "doc_id").distinct().groupBy("low").count().where("count > 1").select("low")
    d = d.join(several, F.lower("name") == F.col("low"), "left")
    return d.withColumn("name", F.concat("name", F.when(F.col("low").isNotNull(), F.concat(F.lit("-"), F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 12))).otherwise(""), F.lit(suffix))).drop("low")


def _each(df: DataFrame, content: str, folder: str, suffix: str) -> None:
    """folder must be reachable by that name from all executors: mounted, or a file system that pyarrow knows."""

    def put(rows):
        for r in rows:
            write_atomic(f"{folder}/{r['name']}", bytes(r[content]) if isinstance(r[content], bytearray) else r[content])

    named(df.select("doc_id", content), suffix).foreachPartition(put)


def write_text(merged: DataFrame, folder: str) -> None:
    _each(merged, "merged", folder, ".txt")


def write_pdf(merged: DataFrame, folder: str, font: FontOptions = FontOptions()) -> None:
    _each(documents(styled(blocks(merged, "merged"), font), font), "pdf", folder, ".pdf")


def sink_format(output_format: Column) -> Column:
    """pdf, or txt for any other format name."""
    return F.when(F.lower(output_format) == "pdf", "pdf").otherwise("txt")


def writer(output_format: str | None):
    """The sink of a format name; anything but pdf is text."""
    return write_pdf if (output_format or "").lower() == "pdf" else write_text


def write_review(results: DataFrame, folder: str) -> None:
    """TO_REVIEW files of documents with chunks to look at; replaces those of an earlier run."""
    _each(review_report(results), "report", folder, "_TO_REVIEW.txt")
