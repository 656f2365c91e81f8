"""Prompts, requests, responses, cache keys and waiting times of model calls, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LANGUAGE_MARK, ModelOptions
from ..schemas import RESPONSE
from .text import is_blank, trim


def system_prompt(template: Column, language: Column) -> Column:
    return F.replace(template, F.lit(LANGUAGE_MARK), language)


def user_prompt(text: Column, language: Column) -> Column:
    return F.concat(F.lit("Translate the following text to "), language, F.lit(".\nReturn only the translated text.\n\nTEXT:\n"), text)


def request(text: Column, language: Column, options: ModelOptions) -> Column:
    """JSON body of a call."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(options.model).alias("model"),
            F.lit(options.temperature).alias("temperature"),
            F.lit(options.max_output_tokens).alias("max_output_tokens"),
            F.lit("auto").alias("truncation"),
            F.array(turn("system", system_prompt(F.lit(options.system_prompt), language)), turn("user", user_prompt(text, language))).alias("input"),
        )
    )


def response_text(body: Column) -> Column:
    """Text of a response, trimmed; null if there is no output array or no text in it."""
    output = F.from_json(body, RESPONSE)["output"]
    messages = F.filter(output, lambda o: F.coalesce(o["type"] == "message", F.lit(False)) & o["content"].isNotNull())
    parts = F.flatten(F.transform(messages, lambda o: F.filter(o["content"], lambda c: F.coalesce(c["type"] == "output_text", F.lit(False)))))
    text = trim(F.array_join(F.transform(parts, lambda c: F.coalesce(c["text"], F.lit(""))), ""))
    return F.when(~is_blank(text), text)


def response_error(body: Column) -> Column:
    """Why response_text is null: no output array, or no text in it."""
    output = F.from_json(body, RESPONSE)["output"]
    return F.when(output.isNull(), "Unexpected response: missing 'output' array.").when(response_text(body).isNull(), "No translated text found in response.")


def cache_key(options: Column) -> Column:
    return F.concat(F.lit("pdftr-"), F.substring(F.sha2(options.cast("binary"), 256), 1, 32))


def http_wait(attempt: Column) -> Column:
    """Seconds before the next call after a failed one."""
    return F.least(F.lit(20.0), F.lit(1.5) * attempt * attempt)


def chunk_wait(attempt: Column) -> Column:
    """Seconds before the next attempt at a chunk."""
    return F.least(F.lit(30), 2 * attempt)
