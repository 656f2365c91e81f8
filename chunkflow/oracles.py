"""DuckDB SQL for the registered queries. RE2 has no lookaround, so some steps are written differently than in Spark."""

from __future__ import annotations

from .functions.text import CAPITALS, HYPHENS, LETTERS, WORD
from .operators.layout import PAGE_SIZES
from .rows import EDGE_ROWS, ERRORS, SIZES, TAGGED, VALIDATION_ROWS

WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
N = "chr(10)"


def _re(c: str, pattern: str, new: str, every: bool = True) -> str:
    return f"regexp_replace({c}, '{pattern}', {new}" + (", 'g')" if every else ")")


def _trim(c: str) -> str:
    return _re(c, rf"^{WS}+|{WS}+$", "''")


def _blank(c: str) -> str:
    return f"coalesce({_re(c, WS + '+', chr(39) * 2)} = '', true)"


def _unix(c: str) -> str:
    return f"replace(replace({c}, chr(13) || chr(10), {N}), chr(13), {N})"


def _utf16(c: str) -> str:
    return f"(length({c}) + length({_re(c, r'[^\x{10000}-\x{10FFFF}]', chr(39) * 2)}))"


def _preprocess(raw: str) -> str:
    c = _unix(raw)
    c = _re(c, r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]", "''")
    c = _re(c, rf"({WORD})[{HYPHENS}]\n({WORD})", r"'\1\2'")
    c = _re(c, r"\n\n+", "chr(1)")
    c = f"replace(replace({c}, {N}, ' '), chr(1), {N} || {N})"
    c = _re(c, r"[ \t]{2,}", "' '")
    for _ in range(2):
        c = _re(c, rf"(\P{{Nd}})(\p{{Nd}}{{1,3}})([{LETTERS}])", r"'\1\2 \3'")
    c = _re(c, rf"^(\p{{Nd}}{{1,3}})([{LETTERS}])", r"'\1 \2'", False)
    c = _re(c, rf"([.!?])([{CAPITALS}])", r"'\1 \2'")
    return f"CASE WHEN {_blank(raw)} THEN {raw} ELSE {_trim(c)} END"


def _sanitize(c: str) -> str:
    x = _re(_unix(c), rf"^{WS}*```[a-zA-Z]*{WS}*\n", "''", False)
    return f"CASE WHEN {_blank(c)} THEN {c} ELSE {_trim(_re(x, rf'\n{WS}*```{WS}*$', chr(39) * 2, False))} END"


def _values(rows: list, names: str) -> str:
    quote = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
    body = ", ".join(f"({i}, {', '.join(quote(v) for v in (r if isinstance(r, tuple) else (r,)))})" for i, r in enumerate(rows))
    return f"(SELECT * FROM (VALUES {body}) AS v(id, {names}))"


RAW = f"SELECT conv_id AS doc_id, string_agg(text || {N} || {N}, '' ORDER BY turn) AS raw FROM conversations GROUP BY conv_id"


def _chunks(docs: str, limit: int) -> str:
    """WITH clauses that end in chunks(doc_id, chunk_index, text); docs has doc_id and raw."""
    cut = _re("p", rf"([.!?]){WS}+", r"'\1' || chr(1)")
    return f"""
    docs AS ({docs}),
    par AS (SELECT doc_id, pno, p FROM (SELECT doc_id, unnest(range(0, len(l))) AS pno, unnest(l) AS p FROM
      (SELECT doc_id, list_filter(list_transform(string_split(raw, {N} || {N}), lambda x: {_trim("x")}), lambda x: x <> '') AS l FROM docs))),
    unit AS (
      SELECT doc_id, pno, 0 AS sno, false AS big, p AS x FROM par WHERE {_utf16("p")} <= {limit}
      UNION ALL
      SELECT doc_id, pno, unnest(range(0, len(s))), true, unnest(s) FROM (SELECT doc_id, pno, string_split({cut}, chr(1)) AS s FROM par WHERE {_utf16("p")} > {limit})
    ),
    seq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pno, sno) AS n, pno, big, x, {_utf16("x")} AS len FROM unit),
    fold(doc_id, n, pno, big, size, idx) AS (
      SELECT doc_id, n, pno, big, len, 0 FROM seq WHERE n = 1
      UNION ALL
      SELECT s.doc_id, s.n, s.pno, s.big,
        CASE WHEN s.big <> f.big OR (s.big AND s.pno <> f.pno) OR f.size + (CASE WHEN s.big THEN 1 ELSE 2 END) + s.len > {limit} THEN s.len ELSE f.size + (CASE WHEN s.big THEN 1 ELSE 2 END) + s.len END,
        CASE WHEN s.big <> f.big OR (s.big AND s.pno <> f.pno) OR f.size + (CASE WHEN s.big THEN 1 ELSE 2 END) + s.len > {limit} THEN f.idx + 1 ELSE f.idx END
      FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.n = f.n + 1
    ),
    chunks AS (
      SELECT f.doc_id, CAST(f.idx AS INTEGER) AS chunk_index,
        CASE WHEN bool_or(f.big) THEN string_agg(s.x, ' ' ORDER BY s.n) ELSE string_agg(s.x, {N} || {N} ORDER BY s.n) END AS text
      FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.n = f.n GROUP BY f.doc_id, f.idx
    )"""


def _chunk_query(docs: str, limit: int, select: str = "SELECT * FROM chunks") -> str:
    return f"WITH RECURSIVE {_chunks(docs, limit)} {select}"


WORDS = f"list_filter(string_split({_re('text', WS + '+', 'chr(1)')}, chr(1)), lambda x: x <> '')"
WORD_CHUNKS = f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 50 + 1 : i * 50 + 50], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 49) // 50)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))"


def _failure(given: str, output: str, chars: int, ratio: float) -> str:
    start = f"lower({_re(output, rf'^{WS}+', chr(39) * 2)})"
    return f"""CASE WHEN {_blank(output)} THEN 'empty' WHEN {_utf16(output)} < {chars} THEN 'short'
      WHEN {_utf16(output)} / greatest(1, {_utf16(f"coalesce({given}, '')")}) < {ratio} THEN 'ratio' WHEN contains({output}, '�') THEN 'replacement'
      WHEN starts_with({start}, 'here is') OR starts_with({start}, 'translation:') OR starts_with({start}, 'tərcümə:') THEN 'chatter' END"""


PAIRS = "SELECT a.conv_id, a.turn, b.text AS given, a.text AS output FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'"
LOG = f"""
    pairs AS ({PAIRS}),
    log AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt, output, {_failure("given", "output", 400, 4.0)} AS why FROM pairs),
    marked AS (SELECT conv_id, attempt, CASE WHEN why IS NULL THEN output END AS output, CASE WHEN why IS NULL THEN NULL WHEN conv_id % 10 = 7 THEN 'OpenAI API error 400: bad' ELSE 'Validation failed: ' || why END AS error,
      why IS NULL AS good, why IS NOT NULL AND conv_id % 10 = 7 AS bad FROM log WHERE attempt <= 3),
    ends AS (SELECT conv_id, min(attempt) FILTER (WHERE good OR bad) AS stop, max(attempt) AS top FROM marked GROUP BY conv_id),
    res AS (SELECT e.conv_id AS chunk_index, CASE WHEN m.good THEN 'Success' WHEN m.bad THEN 'Failed' WHEN e.top >= 3 THEN 'Quarantined' ELSE 'Pending' END AS status, m.output, CASE WHEN m.good OR (NOT m.bad AND e.top < 3) THEN NULL ELSE m.error END AS error, CAST(m.attempt AS INTEGER) AS attempts
      FROM ends e JOIN marked m ON m.conv_id = e.conv_id AND m.attempt = coalesce(e.stop, e.top))"""
RESULTS = "SELECT conv_id AS doc_id, turn AS chunk_index, st AS status, CASE WHEN n % 13 = 0 THEN ' ' || chr(10) WHEN st = 'Success' THEN text END AS output, CASE WHEN st <> 'Success' THEN 'e' || n END AS error FROM (SELECT *, conv_id + 3 * turn AS n, CASE WHEN (conv_id + 3 * turn) % 7 = 0 THEN 'Quarantined' WHEN (conv_id + 3 * turn) % 11 = 0 THEN 'Failed' ELSE 'Success' END AS st FROM conversations)"
GOOD = f"(status = 'Success' AND NOT {_blank('output')})"

_OPEN = rf"(?is)^{WS}*([-*•]{WS}+)?<(H1|H2|P)>{WS}*(.*)$"
LINES = f"""
    tagged AS (SELECT page_id AS doc_id, replace(html, '<', {N} || '<') AS content FROM pages UNION ALL SELECT -1 - id, content FROM {_values(TAGGED, "content")}),
    cut AS (SELECT doc_id, string_split({_re("content", r"\r\n?", N)}, {N}) AS l FROM tagged),
    lines AS (SELECT * FROM (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS line_no, {_trim("unnest(l)")} AS line FROM cut) WHERE line <> '')"""


def _clean(c: str) -> str:
    return _trim(_re(c, r"(?i)</?(?:H1|H2|P)>", "''"))



BLOCKS = f"""{LINES},
    mark AS (SELECT *, nullif(upper(regexp_extract(line, '{_OPEN}', 2)), '') AS opens, nullif(upper(regexp_extract(line, '(?i)^{WS}*</(H1|H2|P)>{WS}*$', 1)), '') AS closes,
      regexp_extract(line, '{_OPEN}', 3) AS body, CASE WHEN regexp_extract(line, '{_OPEN}', 1) <> '' THEN '- ' ELSE '' END AS bullet FROM lines),
    seg AS (SELECT *, sum(CASE WHEN opens IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM mark),
    kinded AS (SELECT *, first_value(CASE WHEN opens IS NOT NULL AND body = '' THEN opens END) OVER (PARTITION BY doc_id, seg ORDER BY line_no) AS seg_kind FROM seg),
    known AS (SELECT *, coalesce(max(CASE WHEN closes = seg_kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY line_no), 0) AS over FROM kinded),
    blocks AS (
      SELECT doc_id, line_no, opens AS kind, {_trim("bullet || CASE WHEN strpos(lower(body), '</' || lower(opens) || '>') > 0 THEN left(body, strpos(lower(body), '</' || lower(opens) || '>') - 1) ELSE body END")} AS text
      FROM known WHERE opens IS NOT NULL AND body <> ''
      UNION ALL
      SELECT doc_id, min(line_no), min(seg_kind), {_clean("string_agg(line, ' ' ORDER BY line_no)")} FROM known WHERE opens IS NULL AND closes IS NULL AND seg_kind IS NOT NULL AND over = 0 GROUP BY doc_id, seg
      UNION ALL
      SELECT doc_id, line_no, 'P', {_clean("line")} || chr(2) FROM known WHERE opens IS NULL AND closes IS NULL AND (seg_kind IS NULL OR over = 1)
    ),
    final AS (SELECT doc_id, line_no, kind, replace(text, chr(2), '') AS text FROM blocks WHERE text <> '')"""
EFFECTIVE = rf"CASE WHEN kind IN ('H1', 'H2') AND starts_with(text, '- ') THEN 'P' WHEN kind = 'H2' AND (regexp_matches(text, '\.{{2,}}{WS}*\p{{Nd}}+{WS}*$') OR {_utf16('text')} > 120) THEN 'P' ELSE kind END"


def _response(kind: str) -> str:
    text = _trim("text || ' !  '")
    if kind == "output":
        return f"CASE WHEN turn % 5 >= 3 THEN NULL ELSE {text} END"
    return "CASE WHEN turn % 5 >= 3 THEN 'Unexpected response: missing ''output'' array.' END"


_LAST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 2 = {0}) WHERE r = 1"
UPPER = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_DEFAULTS = (40, 0.30)

ORACLES = {
    "translate_documents": _chunk_query(f"SELECT doc_id, {_preprocess('raw')} AS raw FROM ({RAW}) WHERE NOT {_blank('raw')}", 600, f"""
      SELECT doc_id, {_sanitize("merged")} AS merged FROM (SELECT doc_id, string_agg({UPPER}, {N} || {N} ORDER BY chunk_index) AS merged FROM chunks WHERE {_failure("text", UPPER, 10, 0.30)} IS NULL GROUP BY doc_id)"""),
    "extract_pages": RAW,
    "empty_source_guard": f"SELECT doc_id, {_blank('text')} AS rejected FROM documents",
    "preprocess_documents": f"SELECT doc_id, {_preprocess('text')} AS clean FROM documents",
    "preprocess_edge_rows": f"SELECT CAST(id AS INTEGER) AS id, {_preprocess('text')} AS clean FROM {_values(EDGE_ROWS, 'text')}",
    "normalize_text": f"WITH p AS (SELECT doc_id, {_unix(f'chr(13) || repeat({N}, 5) || replace(text, ' + chr(39) + '. ' + chr(39) + f', ' + chr(39) + '.' + chr(39) + f' || repeat({N}, 5)) || ' + chr(39) + ' ' + chr(39) + f' || {N}')} AS c FROM documents) SELECT doc_id, {_trim(_re('c', r'\n\n\n\n+', f'repeat({N}, 3)'))} AS stripped, {_trim('c')} AS kept FROM p",
    "sanitize_output": f"WITH p AS (SELECT doc_id, ' ```text' || chr(13) || {N} || text || {N} || ' ``` ' || {N} AS c FROM documents) SELECT doc_id, {_sanitize('c')} AS clean FROM p",
    "paragraph_split": f"SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pno, unnest(l) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(raw, {N} || {N}), lambda x: {_trim('x')}), lambda x: x <> '') AS l FROM ({RAW}))",
    "paragraph_chunks": _chunk_query(RAW, 600),
    "oversize_sentences": _chunk_query(RAW, 60),
    "word_chunks": WORD_CHUNKS,
    "chunk_stats": f"SELECT doc_id, count(*) AS n_chunks, max({_utf16('text')}) AS longest FROM ({WORD_CHUNKS}) GROUP BY doc_id",
    "select_test_chunks": _chunk_query(RAW, 600, "SELECT c.doc_id, CAST(w.pos AS INTEGER) AS chunk_index, c.text FROM chunks c JOIN (VALUES (0, 3), (1, 0), (2, 3)) AS w(pos, i) ON w.i = c.chunk_index WHERE c.doc_id IN (SELECT doc_id FROM chunks GROUP BY doc_id HAVING max(chunk_index) >= 3)"),
    "cache_key": "SELECT doc_id, 'pdftr-' || left(sha256(concat_ws('/', lang, source, doc_id)), 32) AS cache_key FROM documents",
    "options_cache_key": "WITH o AS (SELECT 'Model=gpt-4o-mini, Tokens=4000, Temp=0, BaseUrl=https://api.openai.com/, Prompt=p/Input=, Target=de, Format=pdf, Chunk=10000, Parallel=8, Resume=True/TestChunks=[1,2]' AS options) SELECT options, 'pdftr-' || left(sha256(options), 32) AS cache_key FROM o",
    "checkpoint_paths": "SELECT doc_id, printf('%05d.input.txt', doc_id) AS input, printf('%05d.output.txt', doc_id) AS output, printf('%05d.error.json', doc_id) AS error FROM (SELECT doc_id FROM documents UNION ALL SELECT 123456)",
    "backoff_schedule": "SELECT CAST(a AS INTEGER) AS attempt, CAST(least(20.0, 1.5 * a * a) AS DOUBLE) AS http_wait, CAST(least(30, 2 * a) AS INTEGER) AS chunk_wait FROM range(1, 21) AS t(a)",
    "page_size_lookup": f"SELECT CAST(id AS INTEGER) AS id, CASE WHEN upper(trim(name)) IN ({', '.join(repr(s) for s in PAGE_SIZES)}) THEN upper(trim(name)) ELSE 'A4' END AS page_size FROM {_values(SIZES, 'name')}",
    "enum_lookup": f"SELECT CAST(id AS INTEGER) AS id, CASE lower(trim(name)) WHEN 'a5' THEN 'A5' WHEN 'letter' THEN 'Letter' ELSE 'none' END AS found FROM {_values(SIZES, 'name')}",
    "sink_choice": "SELECT CAST(id AS INTEGER) AS id, CASE WHEN lower(f) = 'pdf' THEN 'pdf' ELSE 'txt' END AS sink FROM (VALUES (0, 'pdf'), (1, 'PDF'), (2, 'txt'), (3, 'docx'), (4, ''), (5, NULL)) AS v(id, f)",
    "render_prompt": f"SELECT conv_id, turn, 'Into L' || turn || '; only L' || turn || '.' AS system, 'Translate the following text to L' || turn || '.' || {N} || 'Return only the translated text.' || {N} || {N} || 'TEXT:' || {N} || text AS user FROM conversations",
    "request_fields": f"SELECT conv_id, turn, 'gpt-4o-mini' AS model, CAST(0 AS DOUBLE) AS temperature, CAST(4000 AS INTEGER) AS max_output_tokens, 'auto' AS truncation, 'To German.' AS system, 'Translate the following text to German.' || {N} || 'Return only the translated text.' || {N} || {N} || 'TEXT:' || {N} || text AS user, 'user' AS role FROM conversations",
    "extract_response": f"SELECT conv_id, turn, {_response('output')} AS output, {_response('error')} AS error FROM conversations",
    "validate_pairs": f"SELECT conv_id, turn, {_failure('given', 'output', 400, 4.0)} AS failure FROM ({PAIRS}) UNION ALL SELECT -1, id, {_failure('given', 'output', *_DEFAULTS)} FROM {_values(VALIDATION_ROWS, 'given, output')}",
    "classify_errors": f"SELECT CAST(id AS INTEGER) AS id, CASE WHEN e IS NULL THEN NULL WHEN contains(lower(e), 'insufficient_quota') THEN 'FATAL' WHEN contains(e, ' 400') THEN 'PERMANENT' ELSE 'RETRY' END AS error_class FROM {_values(ERRORS, 'e')}",
    "resolve_attempts": f"WITH {LOG} SELECT *, CAST(CASE status WHEN 'Pending' THEN 0 WHEN 'Success' THEN 1 WHEN 'Failed' THEN 2 ELSE 3 END AS INTEGER) AS code FROM res",
    "error_records": f"WITH {LOG} SELECT chunk_index, chunk_index AS in_record, attempts, status, error FROM res WHERE status IN ('Failed', 'Quarantined')",
    "resume_split": "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS todo FROM documents",
    "manifest_upsert": f"WITH o AS ({_LAST.format(0)}), n AS ({_LAST.format(1)}) SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.user_id = n.user_id",
    "manifest_roundtrip": "SELECT CAST(user_id % 7 AS VARCHAR) AS doc_id, user_id AS chunk_index, CAST(event_id % 4 AS INTEGER) AS status, CAST(2 AS INTEGER) AS attempts, 'e\"' || chr(10) AS last_error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "merge_success": f"SELECT doc_id, string_agg(output, {N} || {N} ORDER BY chunk_index) AS merged FROM ({RESULTS}) WHERE {GOOD} GROUP BY doc_id",
    "review_report": f"SELECT doc_id, string_agg('----- CHUNK ' || printf('%05d', chunk_index) || ' (' || status || ') -----' || {N} || coalesce(error || {N}, '') || {N}, '' ORDER BY chunk_index) AS report FROM ({RESULTS}) WHERE NOT coalesce({GOOD}, false) GROUP BY doc_id",
    "status_summary": f"SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE status = 'Success') AS n_success, count(*) FILTER (WHERE status = 'Quarantined') AS n_quarantined, count(*) FILTER (WHERE status = 'Failed') AS n_failed FROM ({RESULTS}) GROUP BY doc_id",
    "structured_lines": f"WITH {LINES} SELECT * FROM lines",
    "structured_blocks": f"WITH {BLOCKS} SELECT * FROM final",
    "effective_kind": f"WITH {BLOCKS} SELECT doc_id, line_no, {EFFECTIVE} AS effective_kind FROM final",
    "layout_blocks": f"""WITH {BLOCKS}, k AS (SELECT *, {EFFECTIVE} AS e FROM final) SELECT doc_id, line_no, kind, e AS effective_kind,
      CAST(CASE e WHEN 'H1' THEN 12.5 * 1.6 WHEN 'H2' THEN 12.5 * 1.3 ELSE 12.5 END AS DOUBLE) AS font_size, CASE WHEN e = 'P' THEN 'regular' ELSE 'bold' END AS font,
      CASE e WHEN 'H1' THEN 'center' WHEN 'H2' THEN 'left' ELSE 'justified' END AS align, CAST(CASE WHEN e = 'P' THEN 20 ELSE 0 END AS DOUBLE) AS indent,
      CAST(CASE e WHEN 'H1' THEN 8 WHEN 'H2' THEN 6 ELSE 0 END AS DOUBLE) AS space_before, CAST(CASE e WHEN 'H1' THEN 10 WHEN 'H2' THEN 6 ELSE 0 END AS DOUBLE) AS space_after, CAST(1.2 AS DOUBLE) AS leading, e = 'P' AS hyphenate FROM k""",
}
