"""Attempts in rounds: every round tries all open chunks once and commits what came out before the next begins.

Calls cost money: the translator keeps every answer as soon as it has come (sources.backend.translated), and a round's
answers are written before they are used. A resumed run reads both back and tries the rest.
"""

from __future__ import annotations

import contextlib
import logging
import signal
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelOptions, TranslationOptions
from ..operators import validation
from ..operators.attempts import KEYS, error_class, resume_split, reused_results
from ..schemas import RESULTS
from ..sources import backend
from ..sources.checkpoint import CheckpointStore

log = logging.getLogger("chunkflow.rounds")


class QuotaError(RuntimeError):
    """The service's quota is used up; finished chunks stay in the checkpoint, the manifest is not written."""


class Cancelled(RuntimeError):
    """The run was cancelled; finished rounds and single answers stay in the checkpoint, the manifest is not written."""


class Cancellation:
    """Ends a run from another thread or from a signal: Spark's jobs of the run are interrupted, waits end at once."""

    def __init__(self):
        self.tag, self._asked, self._spark = f"chunkflow-{uuid.uuid4().hex}", threading.Event(), None

    def cancel(self) -> None:
        self._asked.set()
        if self._spark is not None:
            threading.Thread(target=self._spark.sparkContext.cancelJobsWithTag, args=(self.tag,), daemon=True).start()

    def check(self) -> None:
        if self._asked.is_set():
            raise Cancelled("cancelled")

    def wait(self, seconds: float) -> None:
        self._asked.wait(seconds)
        self.check()

    @contextlib.contextmanager
    def running(self, spark: SparkSession) -> Iterator[None]:
        self._spark = spark
        spark.sparkContext.addJobTag(self.tag)
        try:
            self.check()
            yield
        except Exception as e:
            if self._asked.is_set() and not isinstance(e, Cancelled):
                raise Cancelled("cancelled") from e
            raise
        finally:
            spark.sparkContext.removeJobTag(self.tag)

    @contextlib.contextmanager
    def on_signal(self, number: int = signal.SIGINT) -> Iterator[None]:
        """Cancels on the signal (Ctrl+C), in the main thread."""
        before = signal.signal(number, lambda *_: self.cancel())
        try:
            yield
        finally:
            signal.signal(number, before)


def run_rounds(
    chunks: DataFrame,
    store: CheckpointStore,
    translate: Callable[[DataFrame, int], DataFrame],
    options: TranslationOptions,
    source: str = "",
    sleep: Callable[[float], None] | None = None,
    forget: Callable[[DataFrame], None] | None = None,
    cancellation: Cancellation | None = None,
) -> DataFrame:
    """Results of all chunks. translate(chunks, attempt) adds output and error, one of them null.

    forget(chunks): called with the chunks whose answers have failed validation, before they are asked for again.
    """
    cancellation = cancellation or Cancellation()
    with cancellation.running(store.spark):
        return _rounds(chunks, store, translate, options, source, sleep or cancellation.wait, forget, cancellation)


def _rounds(chunks, store, translate, options, source, sleep, forget, cancellation) -> DataFrame:
    spark, run = store.spark, f"{store.folder.rstrip('/')}/runs/{uuid.uuid4().hex}"
    chunks = chunks.select(*KEYS, "text")
    if options.resume:
        _, todo = resume_split(chunks, store.outputs())
        results = reused_results(chunks, store.outputs())
    else:
        todo, results = chunks, spark.createDataFrame([], RESULTS)
    todo = _kept(todo, f"{run}/todo")
    store.mark_inputs(todo)
    results, fatal = _kept(results, f"{run}/reused"), False
    log.info("%d chunks to do, %d skipped (resume)", todo.count(), results.count())
    for attempt in range(1, options.max_attempts_per_chunk + 1):
        cancellation.check()
        if not todo.limit(1).count():
            break
        began = time.time()
        answers = _kept(translate(todo, attempt), f"{run}/answers-{attempt}")
        why = validation.reason(F.col("text"), F.col("output"), options.min_output_chars, options.min_output_to_input_ratio)
        answers = answers.withColumn("invalid", F.col("error").isNull() & why.isNotNull())
        answers = answers.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("invalid"), F.concat(F.lit("Validation failed: "), why)))
        answers = answers.withColumn("kind", error_class(F.col("error")))
        last = attempt == options.max_attempts_per_chunk
        status = F.when(F.col("kind").isNull(), "Success").when(F.col("kind") != "RETRY", "Failed").when(F.lit(last), "Quarantined")
        ended = answers.withColumn("status", status).where("status is not null")
        ended = ended.select(*KEYS, "status", F.when(F.col("status") == "Success", F.col("output")).alias("output"), "error", F.lit(attempt).alias("attempts"))
        store.mark_success(ended)
        if forget:
            forget(answers.where("invalid").select(*KEYS, "text"))
        fatal = fatal or ended.join(answers.where("kind = 'FATAL'"), KEYS, "left_semi").limit(1).count() > 0
        results = results.unionByName(ended)
        todo = answers.where("kind = 'RETRY'").select(*KEYS, "text")
        counts = {r["status"]: r["count"] for r in ended.groupBy("status").count().collect()}
        log.info("attempt %d/%d took %d ms: %s", attempt, options.max_attempts_per_chunk, 1000 * (time.time() - began), counts)
        if not last and todo.limit(1).count():
            sleep(min(30.0, 2.0 * attempt))
    results = _kept(results, f"{run}/results")
    store.mark_errors(results)
    if fatal:
        raise QuotaError("insufficient_quota")
    store.write_manifest(results, source, options.target_language)
    for name in ("todo", "reused", *(f"answers-{k}" for k in range(1, options.max_attempts_per_chunk + 1))):
        store.remove(f"{run}/{name}")
    return results


def translate_over_http(chunks: DataFrame, store: CheckpointStore, options: TranslationOptions, model: ModelOptions, source: str = "", transport: backend.Transport = backend.http, sleep: Callable[[float], None] = time.sleep, key: str | None = None, cancellation: Cancellation | None = None) -> DataFrame:
    """run_rounds() with the HTTP translator; with options.resume, paid answers of a run that broke off are used again."""
    key, language = key or backend.require_key(), options.target_language
    journal = store.journal() if options.resume else None
    translate = lambda todo, _: backend.translated(todo, language, model, options.max_degree_of_parallelism, transport, sleep, key, journal)
    forget = (lambda bad: backend.forget(bad, language, model, journal)) if journal else None
    return run_rounds(chunks, store, translate, options, source, None if sleep is time.sleep else sleep, forget, cancellation)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Written once, read ever after."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
