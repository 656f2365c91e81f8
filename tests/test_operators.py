"""Operators against small models in plain Python, written from the rules."""

import json
import random
import re
import threading
import time
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chunkflow.config import FontOptions, ModelOptions, TranslationOptions, load
from chunkflow.functions.text import normalize, preprocess, sanitize_output, utf16_length
from chunkflow.operators import attempts, chunking, structure, validation
from chunkflow.plans.rounds import Cancellation, Cancelled, QuotaError, run_rounds, translate_over_http
from chunkflow.plans.translate import Pipeline, upper
from chunkflow.sources import backend, pdf, sinks
from chunkflow.sources.checkpoint import CheckpointStore
from chunkflow.yaml import read_yaml


def model_chunks(text, limit):
    out, cur = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        if len(p) > limit:
            if cur:
                out.append(cur)
            cur = ""
            for s in re.split(r"(?<=[.!?])\s+", p):
                if cur and len(cur) + 1 + len(s) > limit:
                    out.append(cur)
                    cur = ""
                cur = f"{cur} {s}" if cur else s
            out.append(cur)
            cur = ""
        elif cur and len(cur) + 2 + len(p) > limit:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + [cur] * bool(cur)


def random_text(rng):
    sentence = lambda: " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 8))) + rng.choice(".!?,")
    return "\n\n".join(rng.choice(["", " ", " ".join(sentence() for _ in range(rng.randint(1, 6)))]) for _ in range(rng.randint(0, 8)))


def test_paragraph_chunks_follow_the_model(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(150)] + ["", "x" * 40, "x" * 41, "a\n\n" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, raw string")
    got = df.select("doc_id", chunking.pack_paragraphs(F.col("raw"), 40).alias("c")).collect()
    for r in got:
        assert r.c == model_chunks(texts[r.doc_id], 40)
    with pytest.raises(ValueError):
        chunking.pack_paragraphs(F.col("raw"), 0)


def test_word_chunks_keep_all_words(spark):
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, raw string")
    for r in df.select("doc_id", chunking.pack_words(F.col("raw"), 7).alias("c")).collect():
        assert " ".join(r.c).split() == texts[r.doc_id].split()
        assert all(len(c.split()) == 7 for c in r.c[:-1])


def test_select_chunks(spark):
    chunks = spark.createDataFrame([("a", i, f"t{i}") for i in range(5)] + [("b", 0, "x")], "doc_id string, chunk_index int, text string")
    pick = lambda w: [(r.doc_id, r.chunk_index, r.text) for r in chunking.select_chunks(chunks, w).orderBy("doc_id", "chunk_index").collect()]
    assert pick([3, 0, 3]) == [("a", 0, "t3"), ("a", 1, "t0"), ("a", 2, "t3")]
    assert pick([5]) == []
    assert len(pick([])) == len(pick(None)) == 6
    with pytest.raises(IndexError):
        chunking.select_chunks(chunks, [-1])
    assert pick([-1, 99]) == []
    with pytest.raises(Exception, match="negative chunk index"):
        pick([-1, 2])


def test_chunking_time_is_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "\n\n".join(f"paragraph {i}" for i in range(n)))], "doc_id int, raw string")
        chunking.paragraph_chunks(df, 10**6).collect()
        began = time.time()
        assert len(chunking.paragraph_chunks(df, 10**6).collect()) == 1
        return time.time() - began

    assert seconds(8000) < 12 * max(seconds(2000), 0.2)


def test_blocks_need_one_shuffle(spark):
    df = spark.createDataFrame([(1, "<P>x")], "doc_id int, content string")
    plan = structure.blocks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Union" not in plan


def test_yaml():
    text = """
    # options
    A:
      B: 5 # five
      C: "x # y: \\"q\\" \\u00e9"
      D: 'it''s'
      L: [1, 2, "a, b", {x: 1}]
      M: {a: 1, b: ~}
      N:
      - 3
      - k: v
        w: 2
      E:
      url: https://x.y:80/z#frag
      F: >-
        folded
        text

        para
      G: |
        lit # text
          more
    """
    import textwrap

    got = read_yaml(textwrap.dedent(text))["A"]
    assert got == {"B": "5", "C": 'x # y: "q" é', "D": "it's", "L": ["1", "2", "a, b", {"x": "1"}], "M": {"a": "1", "b": None}, "N": ["3", {"k": "v", "w": "2"}], "E": None, "url": "https://x.y:80/z#frag", "F": "folded text\npara", "G": "lit # text\n  more\n"}
    assert read_yaml("") == {} and read_yaml("---\na: 1\n---\nb: 2") == {"a": "1"}
    for bad in ("a: [1, 2", "a:\n  b: 1\n c: 2"):
        with pytest.raises(ValueError):
            read_yaml(bad)


def test_text_rules(spark):
    cases = {"a\r\nb\rc": "a b c", "certifi-\ncate": "certificate", "a-\nb-\nc": "ab- c", "x\n\n\n\ny": "x\n\ny", "a1b2c3d4": "a1 b2 c3 d4", "U.S.A. ok": "U. S. A. ok", " \t ": " \t ", "9ıx": "9ıx", "\xa0pad　": "pad", "12ab\n34cd": "12 ab 34 cd"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert df.where(~preprocess(F.col("raw")).eqNullSafe(F.col("want"))).collect() == []
    one = spark.range(1).select(utf16_length(F.lit("a😀é")).alias("n"), sanitize_output(F.lit("```txt\nx\n```y\n```\nz\n```")).alias("s"), normalize(F.lit("a\r\n\n\n\n\nb ")).alias("m")).first()
    assert (one.n, one.s, one.m) == (4, "x\n```y\n```\nz", "a\n\n\nb")


def model_blocks(content):
    out, kind, buffer, closer = [], None, [], re.compile(r"^</(H1|H2|P)>$", re.I)
    clean = lambda t: re.sub(r"</?(?:H1|H2|P)>", "", t, flags=re.I).strip()

    def flush():
        nonlocal kind, buffer
        if kind and clean(" ".join(buffer)):
            out.append((kind, clean(" ".join(buffer))))
        kind, buffer = None, []

    for line in re.split(r"\r\n|\r|\n", content):
        line = line.strip()
        if not line:
            continue
        if m := closer.match(line):
            if kind == m[1].upper():
                flush()
        elif m := re.match(r"^\s*([-*•]\s+)?<(H1|H2|P)>\s*(.*)$", line, re.I):
            flush()
            tag, bullet, body = m[2].upper(), "- " if m[1] else "", m[3]
            at = body.lower().find(f"</{tag.lower()}>")
            if at >= 0:
                if (bullet + body[:at]).strip():
                    out.append((tag, (bullet + body[:at]).strip()))
            elif body:
                out.append((tag, (bullet + body).strip()))
            else:
                kind = tag
        elif kind:
            buffer.append(line)
        else:
            out.append(("P", clean(line)))
    flush()
    return out


def test_blocks_follow_a_state_machine(spark):
    rng = random.Random(5)
    parts = ["<H1>", "<P>", "<h2>", "</P>", "</H1>", "</h2>", "- <P>", "text", "more <P>x", "<P>in</P> tail", "<H1>head", "* <H2>", "", "- <P></P>", "</P></P>"]
    docs = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id int, content string")
    got = {i: [] for i in range(len(docs))}
    for r in structure.blocks(df).orderBy("doc_id", "line_no").collect():
        got[r.doc_id].append((r.kind, r.text))
    for i, d in enumerate(docs):
        assert got[i] == model_blocks(d), d


def test_effective_kind(spark):
    rows = [("H2", "Intro ..... 12", "P"), ("H2", "x" * 121, "P"), ("H1", "Deep .... 3", "H1"), ("H1", "- no", "P"), ("H2", "x" * 120, "H2"), ("P", "p", "P")]
    df = spark.createDataFrame(rows, "k string, t string, want string")
    assert df.where(structure.effective_kind(F.col("k"), F.col("t")) != F.col("want")).count() == 0


def test_reasons(spark):
    df = spark.createDataFrame([("y" * 1000, "z" * 50), ("", "q" * 40), ("x", None)], "i string, o string")
    got = [r[0] for r in df.select(validation.reason(F.col("i"), F.col("o"))).collect()]
    assert got == ["Output/input length ratio too small (0.05 < 0.30).", None, "Empty output."]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, raw string")
    assert chunking.paragraph_chunks(docs, 9).count() == chunking.word_chunks(docs, 9).count() == structure.blocks(docs, "raw").count() == 0
    assert attempts.resolve_attempts(spark.createDataFrame([], "doc_id string, chunk_index int, attempt int, output string, error string")).count() == 0


GOOD = "a translation that is long enough to pass every check"


def scripted(script):
    def translate(chunks, attempt):
        rows = [(d, i, a, o, e) for (d, i), answers in script.items() for a, (o, e) in enumerate(answers, 1)]
        log = chunks.sparkSession.createDataFrame(rows, "doc_id string, chunk_index int, a int, output string, error string")
        return chunks.join(log.where(F.col("a") == attempt).drop("a"), ["doc_id", "chunk_index"])

    return translate


def test_rounds_resume_and_quota(spark, tmp_path):
    chunks = spark.createDataFrame([("d", i, "some text") for i in range(4)], "doc_id string, chunk_index int, text string")
    options, waits = TranslationOptions(target_language="de"), []
    store = CheckpointStore(spark, f"file://{tmp_path}/a")
    script = {("d", 0): [(GOOD, None)], ("d", 1): [(None, "OpenAI API error 400: x")], ("d", 2): [("short", None), (None, "timeout"), (GOOD, None)], ("d", 3): [(None, "e1"), (None, "e2"), ("", None)]}
    got = {r.chunk_index: (r.status, r.attempts, r.error) for r in run_rounds(chunks, store, scripted(script), options, sleep=waits.append).collect()}
    assert got == {0: ("Success", 1, None), 1: ("Failed", 1, "OpenAI API error 400: x"), 2: ("Success", 3, None), 3: ("Quarantined", 3, "Validation failed: Empty output.")}
    assert waits == [2.0, 4.0]
    assert {r.chunk_index: r.status for r in store.manifest_items().collect()} == {0: 1, 1: 2, 2: 1, 3: 3}
    again = {("d", 1): [(GOOD, None)], ("d", 3): [(GOOD, None)]}
    got = {r.chunk_index: (r.status, r.attempts) for r in run_rounds(chunks, store, scripted(again), options, sleep=waits.append).collect()}
    assert got == {0: ("Success", 0), 1: ("Success", 1), 2: ("Success", 0), 3: ("Success", 1)}
    other = CheckpointStore(spark, f"file://{tmp_path}/b")
    script[("d", 1)] = [(None, "429 insufficient_quota")]
    with pytest.raises(QuotaError):
        run_rounds(chunks, other, scripted(script), options, sleep=waits.append)
    assert other.outputs().count() == 2 and other.manifest_items().count() == 0


def test_runs_replace_their_own_chunks_only(spark, tmp_path):
    chunks = lambda d, t="some text": spark.createDataFrame([(d, i, t) for i in range(2)], "doc_id string, chunk_index int, text string")
    store = CheckpointStore(spark, f"file://{tmp_path}/s")
    anew, resumed = TranslationOptions(target_language="de", resume=False), TranslationOptions(target_language="fr")
    for text in (GOOD, GOOD + " again"):
        run_rounds(chunks("d"), store, scripted({("d", 0): [(text, None)], ("d", 1): [(None, " 400")]}), anew, "d.pdf")
    assert [(r.chunk_index, r.output) for r in store.outputs().collect()] == [(0, GOOD + " again")]
    run_rounds(chunks("e", "other"), store, scripted({("e", 0): [(GOOD, None)], ("e", 1): [(None, "x 400")]}), resumed, "e.pdf")
    got = {(r.doc_id, r.chunk_index): (r.status, r.output, r.attempts) for r in run_rounds(chunks("d"), store, scripted({("d", 1): [(GOOD, None)]}), resumed, "d2.pdf").collect()}
    assert got == {("d", 0): ("Success", GOOD + " again", 0), ("d", 1): ("Success", GOOD, 1)}
    assert {(r.doc_id, r.chunk_index): r.status for r in store.manifest_items().collect()} == {("d", 0): 1, ("d", 1): 1, ("e", 0): 1, ("e", 1): 2}
    manifests = {r.doc_id: json.loads(r.manifest) for r in store.manifests().collect()}
    assert (manifests["d"]["sourcePdfPath"], manifests["e"]["targetLanguage"], len(manifests["d"]["items"])) == ("d2.pdf", "fr", 2)
    assert {(r.doc_id, json.loads(r.record)["error"]) for r in store.errors().collect()} == {("d", " 400"), ("e", "x 400")}
    assert {(r.doc_id, r.chunk_index): r.text for r in store.inputs().collect()} == {("d", 0): "some text", ("d", 1): "some text", ("e", 0): "other", ("e", 1): "other"}


def test_answers_outlive_a_run_that_is_killed(spark, tmp_path):
    """A worker dies in the middle of a round: what was answered before is not asked for again."""
    calls, done = tmp_path / "calls", TranslationOptions(target_language="de", max_degree_of_parallelism=1)
    calls.touch()

    def transport(fatal):
        def send(url, headers, body):
            import os

            text = json.loads(body)["input"][1]["content"][-2:]
            with open(calls, "a") as f:
                f.write(text + " ")
            if text == fatal:
                os._exit(1)
            return 200, json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": GOOD if text != "t1" or calls.read_text().count("t1") > 1 else "short"}]}]})

        return send

    chunks = spark.createDataFrame([("d", i, f"some text t{i}") for i in range(6)], "doc_id string, chunk_index int, text string").coalesce(1)
    store = CheckpointStore(spark, f"file://{tmp_path}/k")
    with pytest.raises(Exception):  # noqa: B017
        translate_over_http(chunks, store, done, ModelOptions(), transport=transport("t4"), sleep=lambda s: None, key="k")
    before = Counter(calls.read_text().split())
    assert before["t4"] >= 1 and store.outputs().count() == 0
    got = translate_over_http(chunks, store, done, ModelOptions(), transport=transport(None), sleep=lambda s: None, key="k")
    assert {r.chunk_index: r.status for r in got.collect()} == {i: "Success" for i in range(6)}
    after = Counter(calls.read_text().split())
    assert sum(before.values()) - before["t4"] >= 1
    for t in before:  # t1's short answer is asked for again, the others are read back
        assert after[t] - before[t] == {"t4": 1, "t1": 1}.get(t, 0), (before, after)


def test_cancellation(spark, tmp_path):
    chunks = spark.createDataFrame([("d", i, "some text") for i in range(3)], "doc_id string, chunk_index int, text string")
    store, c = CheckpointStore(spark, f"file://{tmp_path}/c"), Cancellation()
    script = {("d", 0): [(GOOD, None)], ("d", 1): [(None, "e")] * 3, ("d", 2): [(GOOD, None)]}

    def sleep(seconds):
        c.cancel()
        c.wait(seconds)

    with pytest.raises(Cancelled):
        run_rounds(chunks, store, scripted(script), TranslationOptions(), sleep=sleep, cancellation=c)
    assert store.outputs().count() == 2 and store.manifest_items().count() == 0
    with pytest.raises(Cancelled):
        run_rounds(chunks, store, scripted(script), TranslationOptions(), cancellation=c)
    again = run_rounds(chunks, store, scripted({("d", 1): [(GOOD, None)]}), TranslationOptions())
    assert {r.chunk_index: r.attempts for r in again.collect()} == {0: 0, 1: 1, 2: 0}
    slow, began = Cancellation(), time.time()
    threading.Timer(3, slow.cancel).start()
    stuck = lambda todo, attempt: todo.mapInPandas(lambda it: (time.sleep(60) or f for f in it), todo.schema).selectExpr("*", "text output", "string(null) error")
    with pytest.raises(Cancelled):
        run_rounds(chunks, CheckpointStore(spark, f"file://{tmp_path}/x"), stuck, TranslationOptions(), cancellation=slow)
    assert time.time() - began < 50


def test_legacy_outputs(spark, tmp_path):
    for i in (0, 12):
        (tmp_path / f"{i:05d}.output.txt").write_text(f"text {i}\nline")
    (tmp_path / "00001.input.txt").write_text("no")
    store = CheckpointStore(spark, f"file://{tmp_path}/s")
    assert {r.chunk_index: r.output for r in store.legacy_outputs(f"file://{tmp_path}").collect()} == {0: "text 0\nline", 12: "text 12\nline"}


def test_names_of_files_do_not_clash(spark, tmp_path):
    ids = ["a/x.pdf", "b/x.pdf", "b/X.txt", "report.2023", "report.2024", "über alles.pdf", "one"]
    sinks.write_text(spark.createDataFrame([(i, f"of {i}") for i in ids], "doc_id string, merged string"), str(tmp_path))
    files = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert sorted(files.values()) == sorted(f"of {i}" for i in ids) and {"one.txt", "über_alles.txt"} <= set(files)
    results = spark.createDataFrame([(d, 0, "Failed", None, "why", 1) for d in ("a/x.pdf", "b/x.pdf")], "doc_id string, chunk_index int, status string, output string, error string, attempts int")
    sinks.write_review(results, f"{tmp_path}/r")
    assert len(list((tmp_path / "r").glob("x-*_TO_REVIEW.txt"))) == 2


def test_http_backend(spark):
    answers, waits = [(500, "no"), (200, "{}"), (200, json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": " ok "}, {"type": "refusal", "text": "n"}]}]}))], []
    assert backend.call("t", "de", ModelOptions(), "k", lambda *a: answers.pop(0), waits.append) == "ok"
    assert waits == [1.5, 6.0]
    with pytest.raises(RuntimeError, match="OpenAI API error 400: bad"):
        backend.call("t", "de", ModelOptions(), "k", lambda *a: (400, "bad"), waits.append)
    with pytest.raises(RuntimeError, match="OPENAI_API_KEY is not set"):
        backend.require_key({})
    echo = lambda url, h, body: (200, json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": json.loads(body)["input"][1]["content"][-3:]}]}]}))
    chunks = spark.createDataFrame([("d", i, f"abc{i}") for i in range(5)], "doc_id string, chunk_index int, text string")
    got = backend.translated(chunks, "de", ModelOptions(), 2, echo, key="k").collect()
    assert {r.chunk_index: r.output for r in got} == {i: f"bc{i}" for i in range(5)}


def test_config_layers(tmp_path):
    (tmp_path / "c.yml").write_text("OpenAI:\n  Model: m\n  SystemPrompt: |-\n    line one\n\n    - line two\nTranslation:\n  MaxCharsPerChunk: 5\n  Resume: true\nFont:\n  Margins:\n    Top: 1\nTesting:\n  TestChunks:\n   - 3\n   - 0\n")
    o = load(tmp_path / "c.yml", {"Translation__MaxCharsPerChunk": "6", "OpenAI__Model": "n"}, ["--Translation:MaxCharsPerChunk=7", "--Translation:Resume", "false"])
    assert (o.openai.model, o.openai.system_prompt, o.translation.max_chars_per_chunk, o.translation.resume, o.font.margins.top, o.testing.test_chunks) == ("n", "line one\n\n- line two", 7, False, 1.0, (3, 0))
    (tmp_path / "d.yml").write_text("Translation:\n  MaxCharsPerChunk: 5 # c\nTesting: {TestChunks: [1, 2]}\n")
    o = load(tmp_path / "d.yml", {"Testing__TestChunks__1": "7"})
    assert (o.translation.max_chars_per_chunk, o.testing.test_chunks) == (5, (1, 7))
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "none.yml")


def test_sinks_and_pdf(spark, tmp_path):
    merged = spark.createDataFrame([("in/a.pdf", "<H1>Title (one)\n<P>body \\ text " + "word " * 900), ("b", "plain")], "doc_id string, merged string")
    sinks.writer("PDF")(merged, f"{tmp_path}/out")
    sinks.writer("docx")(merged, f"{tmp_path}/out")
    assert (tmp_path / "out/b.txt").read_text() == "plain"
    pages = pdf.page_texts((tmp_path / "out/a.pdf").read_bytes())
    assert len(pages) > 1 and pages[0].startswith("Title (one)\nbody \\ text word") and sum(p.count("word") for p in pages) == 900
    rows = pdf.read_pages(spark, f"{tmp_path}/out").orderBy("doc_id", "page_no").collect()
    assert [r.page_no for r in rows] == [*range(len(pages)), 0]
    assert pdf.document([], FontOptions(page_size="none"))[:5] == b"%PDF-"


STYLE = {"font_size": 12.0, "align": "justified", "indent": 20.0, "space_before": 0.0, "space_after": 0.0, "leading": 1.2, "hyphenate": True, "font": "regular"}
FONTS = Path("/usr/share/fonts/truetype/dejavu")


@pytest.mark.skipif(not FONTS.exists(), reason="no TrueType file")
def test_pdf_with_embedded_fonts_keeps_any_text():
    font = FontOptions(regular_font_style=f"{FONTS}/DejaVuSerif.ttf", bold_font_style=f"{FONTS}/DejaVuSerif-Bold.ttf")
    words = "Azərbaycan dili gözəl ƏÖÜĞİŞÇ Русский ελληνικά".split()
    rng = random.Random(1)
    text = " ".join(rng.choice(words) for _ in range(900))
    data = pdf.document([STYLE | {"text": "Başlıq İ", "font": "bold", "align": "center"}, STYLE | {"text": text, "hyphenate": False}], font)
    pages = pdf.page_texts(data)
    assert len(pages) > 1 and pages[0].startswith("Başlıq İ\n")
    assert " ".join("\n".join(pages).split()[2:]) == text
    joined = re.sub(r"-\n", "", "\n".join(pdf.page_texts(pdf.document([STYLE | {"text": text}], font))))
    assert " ".join(joined.split()) == text
    with pytest.raises(ValueError, match="has no"):
        pdf.document([STYLE | {"text": "漢"}], font)
    with pytest.raises(ValueError, match="TrueType"):
        pdf.document([STYLE | {"text": "gözəl"}])


def test_divided_words():
    assert pdf.divisions("winter") == [3] and pdf.divisions("at") == [] and pdf.divisions("well-known") == [5]
    assert all(3 <= i <= len(w) - 3 for w in ("internationalisation", "hyper\u00adactive", "consonant") for i in pdf.divisions(w))
    lines = pdf._lines("x" * 300 + " winter winter", pdf._Standard(b"Times"), 12.0, 100.0, 0.0, True)
    assert "".join("".join(line) for line in lines).replace("-", "") == "x" * 300 + "winterwinter"


def pdf_of(objects, streams=()):
    """A file of numbered bodies; streams are compressed."""
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        out += b"%d 0 obj %s endobj\n" % (n, body)
    for n, (head, body) in dict(streams).items():
        body = zlib.compress(body)
        out += b"%d 0 obj <<%s/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream endobj\n" % (n, head, len(body), body)
    return out


def test_pdf_reader_follows_the_page_tree_and_maps():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <41> <43> <0259> endbfrange 2 beginbfchar <61> <0066006C> <62> <D83DDE00> endbfchar"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[9 0 R 3 0 R]/Resources<</Font<</F 8 0 R/G 12 0 R>>>>>>", 3: b"<</Type/Page/Contents[4 0 R 5 0 R]>>",
        9: b"<</Type /Page % first page \n /Contents 7 0 R>>", 8: b"<</Type/Font/Subtype/TrueType/ToUnicode 6 0 R>>", 12: b"<</Subtype/Type1/Encoding<</Differences[65/uni018F/fi]>>>>",
    }
    streams = {4: (b"", b"BT /F 12 Tf 0 700 Td <41 42> Tj"), 5: (b"", b"0 -14 Td [(a) -300 (b)] TJ T* (C) ' ET"), 6: (b"", cmap), 7: (b"", rb"BT /G 9 Tf 1 0 0 1 5 5 Tm (A\102 \(nested (x)\)) Tj ET q BI /W 1 ID xx EI Q")}
    data = pdf_of(objects, streams) + b"trailer<</Root 1 0 R>>"
    assert pdf.page_texts(data) == ["Əfi (nested (x))", "əɚ\nfl 😀\nɛ"]
    packed = b"".join(b"%d %d " % (n, sum(len(objects[k]) + 1 for k in list(objects)[:i])) for i, n in enumerate(objects))
    bodies = b"".join(b + b" " for b in objects.values())
    inside = {20: (b"/Type/ObjStm/N %d/First %d" % (len(objects), len(packed)), packed + bodies), 21: (b"/Type/XRef/Root 1 0 R", b"")}
    assert pdf.page_texts(pdf_of({}, streams | inside)) == pdf.page_texts(data)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.page_texts(data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 5 0 R"))
    assert pdf.page_texts(b"") == []


def test_stream(spark, tmp_path):
    from chunkflow.streaming.incremental import pages_stream, translate_stream

    spark.createDataFrame([("d", 0, "One. " * 20), ("d", 1, "two")], "doc_id string, page_no int, text string").write.parquet(f"{tmp_path}/in")
    plan = Pipeline(TranslationOptions(target_language="X", min_output_chars=1), translator=upper)
    translate_stream(pages_stream(spark, f"{tmp_path}/in"), plan, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.merged for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("ONE. " * 20).strip() + "\n\nTWO"]
