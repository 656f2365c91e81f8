"""Translation over HTTP, in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import LANGUAGE_MARK, ModelOptions
from .files import read_if_there, remove_if_there, write_atomic

log = logging.getLogger("chunkflow.backend")

#: (url, headers, body) to (status, body).
Transport = Callable[[str, dict, bytes], tuple[int, str]]
MOST_CALLS = 5


def http(url: str, headers: dict, body: bytes) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=600) as r:
            return r.status, r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def require_key(env=None) -> str:
    key = (os.environ if env is None else env).get("OPENAI_API_KEY", "")
    if not key.strip():
        raise RuntimeError("OPENAI_API_KEY is not set.")
    return key


def text_of(body: str) -> str:
    d = json.loads(body)
    if not isinstance(d, dict) or not isinstance(d.get("output"), list):
        raise RuntimeError("Unexpected response: missing 'output' array.")
    items = [i for i in d["output"] if isinstance(i, dict) and i.get("type") == "message" and isinstance(i.get("content"), list)]
    text = "".join(c.get("text") or "" for i in items for c in i["content"] if isinstance(c, dict) and c.get("type") == "output_text").strip()
    if not text:
        raise RuntimeError("No translated text found in response.")
    return text


def call(text: str, language: str, options: ModelOptions, key: str, transport: Transport = http, sleep=time.sleep) -> str:
    """One translation, with up to MOST_CALLS calls and growing waits between them; the last error is raised."""
    turns = [{"role": "system", "content": options.system_prompt.replace(LANGUAGE_MARK, language)}, {"role": "user", "content": f"Translate the following text to {language}.\nReturn only the translated text.\n\nTEXT:\n{text}"}]
    body = json.dumps({"model": options.model, "temperature": options.temperature, "max_output_tokens": options.max_output_tokens, "truncation": "auto", "input": turns}).encode()
    for n in range(1, MOST_CALLS + 1):
        try:
            status, answer = transport(f"{options.base_url.rstrip('/')}/v1/responses", {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, body)
            if not 200 <= status < 300:
                raise RuntimeError(f"OpenAI API error {status}: {answer}")
            return text_of(answer)
        except Exception:
            if n == MOST_CALLS:
                raise
            sleep(min(20.0, 1.5 * n * n))
    raise AssertionError


def answer_file(journal: str, doc_id: str, chunk_index: int, text: str, language: str, options: ModelOptions) -> str:
    """Where a paid answer to just this request is kept."""
    name = hashlib.sha256(json.dumps([doc_id, chunk_index, text, language, options.key()]).encode()).hexdigest()
    return f"{journal.rstrip('/')}/{name[:2]}/{name}.json"


def translated(chunks: DataFrame, language: str, options: ModelOptions, parallelism: int, transport: Transport = http, sleep=time.sleep, key: str | None = None, journal: str | None = None) -> DataFrame:
    """doc_id, chunk_index, text, output, error: one attempt at each chunk, at most `parallelism` at a time.

    journal: folder that all executors share. An answer is stored there as soon as it has come; a repeated task, a lost
    executor's successor or a resumed run reads it back and does not call again. Errors are not stored. An answer that
    has failed its validation is forgotten with forget().
    """
    key = key or require_key()

    def one(doc_id: str, chunk_index: int, text: str) -> str:
        path = journal and answer_file(journal, doc_id, chunk_index, text, language, options)
        if path and (stored := read_if_there(path)) is not None:
            return json.loads(stored)["output"]
        began = time.time()
        output = call(text, language, options, key, transport, sleep)
        log.info("chunk %s of %s answered in %d ms", chunk_index, doc_id, 1000 * (time.time() - began))
        if path:
            write_atomic(path, json.dumps({"output": output}))
        return output

    def run(it):
        for f in it:
            outputs, errors = [], []
            for doc_id, chunk_index, text in zip(f["doc_id"], f["chunk_index"], f["text"]):
                try:
                    outputs.append(one(doc_id, int(chunk_index), text))
                    errors.append(None)
                except Exception as e:
                    log.warning("chunk %s of %s failed: %s", chunk_index, doc_id, e)
                    outputs.append(None)
                    errors.append(str(e))
            yield f.assign(output=outputs, error=errors)

    kinds = ", ".join(f"{n} {t}" for n, t in chunks.dtypes)
    return chunks.repartition(parallelism, "doc_id", "chunk_index").mapInPandas(run, f"{kinds}, output string, error string")


def forget(chunks: DataFrame, language: str, options: ModelOptions, journal: str) -> None:
    """Removes the stored answers of chunks that are to be asked for again."""

    def run(rows):
        for r in rows:
            remove_if_there(answer_file(journal, r["doc_id"], r["chunk_index"], r["text"], language, options))

    chunks.select("doc_id", "chunk_index", "text").foreachPartition(run)
