"""The pipeline over documents: quality, near-duplicates, PII, mixing, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkflow.llm.common import discard, saved, settled, table
from chunkflow.llm.mixing import TARGETS, mix, written_order
from chunkflow.llm.near_dup import near_duplicates
from chunkflow.llm.packing import pack_sized, sizes_and_copies
from chunkflow.llm.pii import replace_pii
from chunkflow.llm.quality import keep_good


def quality_stage(spark, docs, sf_dir):
    """Drops the documents that the classifier rejects.

    Null and empty texts, null ids and repeated rows are scored like others; without labels every document stays.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group.

    Rows without an id are not compared and stay; texts without words are in no group and stay. Rows that share an id
    are one document: it stays if one of them is the smallest of its group, as the row with the least text (null first).
    """
    found = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    found = saved(found, "kept")
    out = docs.join(found.where("not kept").select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
    twice = found.where("kept and rows > 1").select("doc_id")
    if twice.limit(1).count():
        row = F.struct(*docs.columns)
        one = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
        out = out.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one)
    return out


def pii_stage(spark, docs, sf_dir):
    """Replaces personal data in the texts; every row stays, null and clean texts as they are, n_chars is renewed."""
    return replace_pii(docs).select(docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """Writes the documents in the order in which the sources are mixed to their target weights.

    Every row stays. A null source is a source; null and repeated ids are rows like others.
    """
    return written_order(mix(docs, TARGETS, "doc_id")).select(docs.columns)


def packing_stage(spark, docs, sf_dir):
    """Packs the documents into bins that follow the mix; its slots are worked out again, as stages pass documents alone.

    One row for each piece: doc_id, piece, n_tokens, bin, offset. Null and empty texts are an end token; null ids are
    packed, and rows that repeat an id each.
    """
    return pack_sized(mix(sizes_and_copies(docs), TARGETS, "doc_id"), slot="mix_slot")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The classifier and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Applies the stages to documents, each written as Parquet and read again; what a stage leaves behind is removed."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return docs
