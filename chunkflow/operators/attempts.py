"""States of chunks: classes of errors, attempts, resumption, the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STATUS_CODES

KEYS = ["doc_id", "chunk_index"]


def error_class(error: Column) -> Column:
    """FATAL: the quota is used up, the run ends. PERMANENT: the request is bad. RETRY: anything else. Null: no error."""
    return F.when(error.isNull(), F.lit(None).cast("string")).when(F.lower(error).contains("insufficient_quota"), "FATAL").when(error.contains("OpenAI API error 400") | error.contains(" 400"), "PERMANENT").otherwise("RETRY")


def status_code(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in STATUS_CODES.items():
        out = F.when(status == name, code).otherwise(out)
    return out


def resolve_attempts(log: DataFrame, most: int = 3) -> DataFrame:
    """Results from a log of attempts (doc_id, chunk_index, attempt, output, error): the first that ends a chunk counts.

    An attempt ends it by an output without error (Success) or by a fatal or permanent error (Failed). Otherwise the
    chunk is Quarantined after `most` attempts, with its last error, and Pending before. One aggregation with partial
    sums, no window.
    """
    kind = error_class(F.col("error"))
    used = log.where(F.col("attempt") <= most).withColumn("kind", kind)
    row = F.struct("attempt", "kind", "output", "error")
    ends = F.col("kind").isNull() | (F.col("kind") != "RETRY")
    g = used.groupBy(*KEYS).agg(F.min(F.when(ends, row)).alias("end"), F.max(row).alias("last"))
    status = F.when(F.col("end").isNotNull(), F.when(F.col("end.kind").isNull(), "Success").otherwise("Failed")).when(F.col("last.attempt") >= most, "Quarantined").otherwise("Pending")
    error = F.coalesce(F.when(F.col("end").isNotNull(), F.col("end.error")).otherwise(F.coalesce(F.col("last.error"), F.lit("Unknown error"))))
    return g.select(*KEYS, status.alias("status"), F.when(status == "Success", F.col("end.output")).alias("output"), F.when(status.isin("Failed", "Quarantined"), error).alias("error"), F.coalesce("end.attempt", "last.attempt").alias("attempts"))


def resume_split(chunks: DataFrame, done: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(chunks with a stored output, chunks still to do)."""
    stored = done.select(*keys).distinct()
    return chunks.join(stored, keys, "left_semi"), chunks.join(stored, keys, "left_anti")


def reused_results(chunks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Results of chunks with a stored output: Success with 0 attempts, not validated again."""
    got = chunks.select(*KEYS).join(outputs.select(*KEYS, "output"), KEYS)
    return got.select(*KEYS, F.lit("Success").alias("status"), "output", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; a partial aggregation, so a hot key is reduced before it moves."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(top).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose key is not in new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def numbered(rows: DataFrame, keys: list[str], order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))


def error_record(results: DataFrame) -> DataFrame:
    """doc_id, chunk_index and the JSON record of each chunk that failed or was quarantined."""
    bad = results.where(F.col("status").isin("Failed", "Quarantined"))
    record = F.to_json(F.struct(F.col("chunk_index").alias("chunkIndex"), "attempts", "status", "error"))
    return bad.select(*KEYS, record.alias("record"))
