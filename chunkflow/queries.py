"""Registered queries: every operator over a whole table of the test data, or over fixed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ModelOptions, TestingOptions, TranslationOptions
from .functions import model_io
from .functions.text import normalize, preprocess, sanitize_output, utf16_length
from .operators import attempts, chunking, layout, merging, structure, validation
from .plans.translate import Pipeline, extract, reject_empty, upper
from .rows import EDGE_ROWS, ERRORS, SIZES, TAGGED, VALIDATION_ROWS
from .sources import checkpoint, sinks

MIN_CHARS, MIN_RATIO = 400, 4.0


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark, d) -> DataFrame:
    c = _table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def _raw(spark, d) -> DataFrame:
    return extract(_pages(spark, d))


def _fixed(spark, rows, names) -> DataFrame:
    return spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"id int, {names}")


def extract_pages(spark, d):
    return _raw(spark, d)


def empty_source_guard(spark, d):
    docs = reject_empty(_table(spark, d, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.col("reason").isNotNull().alias("rejected"))


def preprocess_documents(spark, d):
    return _table(spark, d, "documents").select("doc_id", preprocess(F.col("text")).alias("clean"))


def preprocess_edge_rows(spark, d):
    return _fixed(spark, EDGE_ROWS, "text string").select("id", preprocess(F.col("text")).alias("clean"))


def normalize_text(spark, d):
    padded = F.concat(F.lit("\r\n\n\n\n\n"), F.replace("text", F.lit(". "), F.lit(".\n\n\n\n\n")), F.lit(" \n"))
    return _table(spark, d, "documents").select("doc_id", normalize(padded).alias("stripped"), normalize(padded, False).alias("kept"))


def sanitize(spark, d):
    fenced = F.concat(F.lit(" ```text\r\n"), "text", F.lit("\n ``` \n"))
    return _table(spark, d, "documents").select("doc_id", sanitize_output(fenced).alias("clean"))


def paragraph_split(spark, d):
    return _raw(spark, d).select("doc_id", F.posexplode(chunking.paragraphs(F.col("raw"))).alias("pno", "p"))


def paragraph_chunks(spark, d):
    return chunking.paragraph_chunks(_raw(spark, d), 600)


def oversize_sentences(spark, d):
    return chunking.paragraph_chunks(_raw(spark, d), 60)


def word_chunks(spark, d):
    return chunking.word_chunks(_table(spark, d, "documents"), 50, "text")


def chunk_stats(spark, d):
    c = word_chunks(spark, d)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(utf16_length(F.col("text"))).cast("long").alias("longest"))


def select_test_chunks(spark, d):
    return chunking.select_chunks(chunking.paragraph_chunks(_raw(spark, d), 600), [3, 0, 3])


def cache_key(spark, d):
    return _table(spark, d, "documents").select("doc_id", model_io.cache_key(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))).alias("cache_key"))


def options_cache_key(spark, d):
    raw = "/".join(o.key() for o in (ModelOptions(system_prompt="p"), TranslationOptions(target_language="de"), TestingOptions((1, 2))))
    return spark.range(1).select(F.lit(raw).alias("options"), model_io.cache_key(F.lit(raw)).alias("cache_key"))


def checkpoint_paths(spark, d):
    p = lambda kind: checkpoint.chunk_file(F.col("doc_id"), kind)
    ids = _table(spark, d, "documents").select("doc_id").union(spark.range(123456, 123457))
    return ids.select("doc_id", p("input.txt").alias("input"), p("output.txt").alias("output"), p("error.json").alias("error"))


def backoff_schedule(spark, d):
    a = spark.range(1, 21).select(F.col("id").cast("int").alias("attempt"))
    return a.select("attempt", model_io.http_wait(F.col("attempt")).alias("http_wait"), model_io.chunk_wait(F.col("attempt")).alias("chunk_wait"))


def page_size_lookup(spark, d):
    return _fixed(spark, SIZES, "name string").select("id", layout.page_size(F.col("name")).alias("page_size"))


def enum_lookup(spark, d):
    return _fixed(spark, SIZES, "name string").select("id", layout.parsed_name(F.col("name"), ["A5", "Letter"], "none").alias("found"))


def sink_choice(spark, d):
    return _fixed(spark, ["pdf", "PDF", "txt", "docx", "", None], "format string").select("id", sinks.sink_format(F.col("format")).alias("sink"))


def render_prompt(spark, d):
    lang = F.concat(F.lit("L"), F.col("turn").cast("string"))
    system = model_io.system_prompt(F.lit("Into {{ target_language }}; only {{ target_language }}."), lang)
    return _table(spark, d, "conversations").select("conv_id", "turn", system.alias("system"), model_io.user_prompt(F.col("text"), lang).alias("user"))


def request_fields(spark, d):
    body = model_io.request(F.col("text"), F.lit("German"), ModelOptions(system_prompt="To {{ target_language }}."))
    schema = "struct<model:string,temperature:double,max_output_tokens:int,truncation:string,input:array<struct<role:string,content:string>>>"
    r = _table(spark, d, "conversations").select("conv_id", "turn", F.from_json(body, schema).alias("r"))
    return r.select("conv_id", "turn", "r.model", "r.temperature", "r.max_output_tokens", "r.truncation", F.col("r.input")[0]["content"].alias("system"), F.col("r.input")[1]["content"].alias("user"), F.col("r.input")[1]["role"].alias("role"))


def _response():
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(part("output_text", F.col("text")), part("refusal", F.lit("no")), part("output_text", F.lit(" !  ")))
    item = F.array(F.struct(F.lit("reasoning").alias("type"), F.array(part("output_text", F.lit("x"))).alias("content")), F.struct(F.lit("message").alias("type"), content.alias("content")))
    return F.when(F.col("turn") % 5 == 4, F.lit('{"output": "none"}')).when(F.col("turn") % 5 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(item.alias("output"))))


def extract_response(spark, d):
    c = _table(spark, d, "conversations").withColumn("body", _response())
    return c.select("conv_id", "turn", model_io.response_text(F.col("body")).alias("output"), model_io.response_error(F.col("body")).alias("error"))


def _pairs(spark, d):
    """Assistant turns with the turn before."""
    c = _table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("given"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", "given", F.col("text").alias("output"))


def validate_pairs(spark, d):
    code = validation.failure(F.col("given"), F.col("output"), MIN_CHARS, MIN_RATIO)
    rows = _fixed(spark, VALIDATION_ROWS, "given string, output string").select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), validation.failure(F.col("given"), F.col("output")).alias("failure"))
    return _pairs(spark, d).select("conv_id", "turn", code.alias("failure")).unionByName(rows)


def classify_errors(spark, d):
    return _fixed(spark, ERRORS, "error string").select("id", attempts.error_class(F.col("error")).alias("error_class"))


def _log(spark, d):
    """A conversation is a chunk, its assistant turns are attempts."""
    pairs = _pairs(spark, d).withColumn("attempt", attempts.numbered(None, ["conv_id"], "turn"))
    why = validation.failure(F.col("given"), F.col("output"), MIN_CHARS, MIN_RATIO)
    error = F.when(why.isNotNull(), F.when(F.col("conv_id") % 10 == 7, F.lit("OpenAI API error 400: bad")).otherwise(F.concat(F.lit("Validation failed: "), why)))
    return pairs.select(F.lit("d").alias("doc_id"), F.col("conv_id").alias("chunk_index"), "attempt", F.when(error.isNull(), F.col("output")).alias("output"), error.alias("error"))


def resolve_attempts(spark, d):
    return attempts.resolve_attempts(_log(spark, d)).select("chunk_index", "status", "output", "error", "attempts", attempts.status_code(F.col("status")).alias("code"))


def error_records(spark, d):
    r = attempts.error_record(attempts.resolve_attempts(_log(spark, d)))
    j = F.from_json("record", "chunkIndex long, attempts int, status string, error string")
    return r.select("chunk_index", j["chunkIndex"].alias("in_record"), j["attempts"].alias("attempts"), j["status"].alias("status"), j["error"].alias("error"))


def resume_split(spark, d):
    docs, done = _table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels").select("doc_id")
    have, todo = attempts.resume_split(docs, done, ["doc_id"])
    return have.withColumn("todo", F.lit(False)).unionByName(todo.withColumn("todo", F.lit(True)))


def manifest_upsert(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    old, new = (attempts.last_write(e.where(f"event_id % 2 = {k}"), ["user_id"], ["ts", "event_id"]) for k in (0, 1))
    return attempts.upsert(old, new, ["user_id"]).select("user_id", "event_id", "event_type", "value")


def manifest_roundtrip(spark, d):
    from .sources.checkpoint import items_of, manifest_of

    e = _table(spark, d, "events")
    rows = attempts.last_write(e.select(F.col("user_id").alias("chunk_index"), "event_id", "ts"), ["chunk_index"], ["ts", "event_id"])
    rows = rows.select((F.col("chunk_index") % 7).cast("string").alias("doc_id"), "chunk_index", (F.col("event_id") % 4).cast("int").alias("status"), F.lit(2).alias("attempts"), F.lit("e\"\n").alias("last_error"), F.col("ts").alias("updated_at"))
    return items_of(manifest_of(rows)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "status", "attempts", "last_error")


def _results(spark, d):
    """Turns as chunks; every seventh quarantined, every eleventh failed, every thirteenth blank."""
    c, n = _table(spark, d, "conversations"), F.col("conv_id") + 3 * F.col("turn")
    status = F.when(n % 7 == 0, "Quarantined").when(n % 11 == 0, "Failed").otherwise("Success")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), status.alias("status"), F.when(n % 13 == 0, " \n").when(status == "Success", F.col("text")).alias("output"), F.when(status != "Success", F.concat(F.lit("e"), n.cast("string"))).alias("error"))


def merge_success(spark, d):
    return merging.merge_success(_results(spark, d))


def review_report(spark, d):
    return merging.review_report(_results(spark, d))


def status_summary(spark, d):
    return merging.status_summary(_results(spark, d))


def _tagged(spark, d):
    p = _table(spark, d, "pages").select("page_id", F.replace("html", F.lit("<"), F.lit("\n<")).alias("content"))
    fixed = _fixed(spark, TAGGED, "content string").select((-1 - F.col("id")).cast("long").alias("page_id"), "content")
    return p.unionByName(fixed).withColumnRenamed("page_id", "doc_id")


def structured_lines(spark, d):
    return structure.lines(_tagged(spark, d))


def structured_blocks(spark, d):
    return structure.blocks(_tagged(spark, d))


def effective_kind(spark, d):
    b = structure.blocks(_tagged(spark, d))
    return b.select("doc_id", "line_no", structure.effective_kind(F.col("kind"), F.col("text")).alias("effective_kind"))


def layout_blocks(spark, d):
    return layout.styled(structure.blocks(_tagged(spark, d))).drop("text")


def translate_documents(spark, d):
    options = TranslationOptions(target_language="Upper", max_chars_per_chunk=600, min_output_chars=10)
    return Pipeline(options, translator=upper).run(_pages(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        translate_documents, extract_pages, empty_source_guard, preprocess_documents, preprocess_edge_rows, normalize_text, paragraph_split,
        paragraph_chunks, oversize_sentences, word_chunks, chunk_stats, select_test_chunks, cache_key, options_cache_key, checkpoint_paths, backoff_schedule,
        page_size_lookup, enum_lookup, sink_choice, render_prompt, request_fields, extract_response, validate_pairs, classify_errors, resolve_attempts,
        error_records, resume_split, manifest_upsert, manifest_roundtrip, merge_success, review_report, status_summary, structured_lines,
        structured_blocks, effective_kind, layout_blocks,
    )
} | {"sanitize_output": sanitize}
