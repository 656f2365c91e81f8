"""Checkpoints: tables of inputs, outputs and errors, and the manifest, one row for each chunk.

Outputs are the truth: a chunk is done if it has a row there. Every write is appended with its time, and the last write
of a chunk is read, so a run replaces what it writes again and leaves other chunks and documents as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attempts import KEYS, error_record, last_write
from ..schemas import MANIFEST

#: Columns of the tables beside doc_id, chunk_index and written_at.
TABLES = {
    "inputs": "text string",
    "outputs": "output string",
    "errors": "record string",
    "manifest": "status int, attempts int, last_error string, updated_at timestamp, source string, language string",
}


def chunk_file(chunk_index: Column, kind: str) -> Column:
    """Name of a chunk's file in a folder of single files; kind: input.txt, output.txt or error.json."""
    return F.format_string(f"%05d.{kind}", chunk_index)


def manifest_of(items: DataFrame, source: str = "", language: str = "") -> DataFrame:
    """doc_id and the JSON manifest of its items (chunk_index, status, attempts, last_error, updated_at)."""
    return _manifest(items, F.lit(source), F.lit(language))


def _manifest(items: DataFrame, source: Column, language: Column) -> DataFrame:
    item = F.struct("status", "attempts", F.col("last_error").alias("lastError"), F.col("updated_at").alias("updatedAt"))
    of = F.map_from_entries(F.collect_list(F.struct(F.col("chunk_index").cast("string"), item)))
    body = F.struct(source.alias("sourcePdfPath"), language.alias("targetLanguage"), F.min("updated_at").alias("startedAt"), of.alias("items"))
    return items.groupBy("doc_id").agg(F.to_json(body).alias("manifest"))


def items_of(manifests: DataFrame) -> DataFrame:
    """The items of manifests; a missing or null manifest has none."""
    items = F.from_json("manifest", MANIFEST)["items"]
    rows = manifests.select("doc_id", F.explode(items).alias("chunk_index", "i"))
    return rows.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "i.status", "i.attempts", F.col("i.lastError").alias("last_error"), F.col("i.updatedAt").alias("updated_at"))


@dataclass(frozen=True)
class CheckpointStore:
    spark: SparkSession
    folder: str

    def _at(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _last(self, name: str) -> DataFrame:
        """The last write of each chunk."""
        schema = f"doc_id string, chunk_index int, written_at timestamp, {TABLES[name]}"
        rows = self.spark.read.schema(schema).parquet(self._at(name)) if self._exists(name) else self.spark.createDataFrame([], schema)
        return last_write(rows, KEYS, ["written_at"])

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", F.current_timestamp().alias("written_at"), *columns).write.mode("append").parquet(self._at(name))

    def journal(self) -> str:
        """Folder of the answers that have been paid for, one file each."""
        return self._at("answers")

    def inputs(self) -> DataFrame:
        return self._last("inputs").drop("written_at")

    def outputs(self) -> DataFrame:
        return self._last("outputs").drop("written_at")

    def errors(self) -> DataFrame:
        return self._last("errors").drop("written_at")

    def legacy_outputs(self, folder: str) -> DataFrame:
        """Outputs of one document in files like 00012.output.txt."""
        files = self.spark.read.option("pathGlobFilter", "*.output.txt").text(folder, wholetext=True)
        index = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.output", 1).cast("int")
        return files.select(index.alias("chunk_index"), F.col("value").alias("output"))

    def mark_inputs(self, chunks: DataFrame) -> None:
        self._append("inputs", chunks)

    def mark_success(self, results: DataFrame) -> None:
        self._append("outputs", results.where("status = 'Success' and attempts > 0"))

    def mark_errors(self, results: DataFrame) -> None:
        self._append("errors", error_record(results))

    def write_manifest(self, results: DataFrame, source: str, language: str) -> None:
        from ..operators.attempts import status_code

        self._append("manifest", results.select(*KEYS, status_code(F.col("status")).alias("status"), "attempts", F.col("error").alias("last_error"), F.current_timestamp().alias("updated_at"), F.lit(source).alias("source"), F.lit(language).alias("language")))

    def manifest_items(self) -> DataFrame:
        return self._last("manifest").select(*KEYS, "status", "attempts", "last_error", "updated_at")

    def manifests(self) -> DataFrame:
        """doc_id and the JSON manifest of each document, with the source and the language that were written last."""
        items = self._last("manifest")
        last = F.max_by(F.struct("source", "language"), "written_at")
        return _manifest(items, last["source"], last["language"])
