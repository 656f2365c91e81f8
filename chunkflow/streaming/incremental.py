"""Pages that arrive as a stream of files: each batch of documents goes through the same plan, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.translate import Pipeline
from ..schemas import PAGES


def pages_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of pages; all pages of a document arrive in one file."""
    return spark.readStream.schema(PAGES).parquet(folder)


def translate_stream(pages: DataFrame, pipeline: Pipeline, out: str, checkpoint: str):
    """Starts a query that writes each batch's merged documents under out/batch=N; a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        pipeline.run(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
