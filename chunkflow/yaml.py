"""YAML as configuration files use it: maps, lists, quoted and plain scalars over several lines, block scalars, flow
collections, comments, anchors and document marks. Scalars stay text; null, ~ and nothing are None."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},"'&*!|>%@`?-][^#:]*?(?:(?::(?=\S)|(?<=\S)#)[^#:]*?)*|[?-][^\s#:][^#:]*?)\s*:(?=\s|$)""")


def _strip(line: str) -> str:
    """The line without its comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (c == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(s: str):
    s = re.sub(r"^(?:[&!]\S*\s+)+", "", s.strip())
    if s[:1] == '"' and s[-1:] == '"' and len(s) > 1:
        return json.loads(re.sub(r"\\x([0-9A-Fa-f]{2})", r"\\u00\1", re.sub(r"\\([ ' 0aev_])", lambda m: {"0": "\\u0000", "a": "\\u0007", "e": "\\u001b", "v": "\\u000b", "_": "\\u00a0"}.get(m[1], m[1]), s)), strict=False)
    if s[:1] == "'" and s[-1:] == "'" and len(s) > 1:
        return s[1:-1].replace("''", "'")
    return None if s in ("", "~", "null", "Null", "NULL") else s


def _flow(s: str, i: int = 0):
    """A flow value from place i: the value and the place behind it."""
    while i < len(s) and s[i].isspace():
        i += 1
    if s[i : i + 1] in ("[", "{"):
        closing, i = {"[": "]", "{": "}"}[s[i]], i + 1
        out: list | dict = [] if closing == "]" else {}
        while True:
            while i < len(s) and (s[i].isspace() or s[i] == ","):
                i += 1
            if i >= len(s):
                raise ValueError("a flow collection does not end")
            if s[i] == closing:
                return out, i + 1
            value, i = _flow(s, i)
            while i < len(s) and s[i].isspace():
                i += 1
            if s[i : i + 1] == ":":
                other, i = _flow(s, i + 1)
                if isinstance(out, dict):
                    out[value] = other
                else:
                    out.append({value: other})
            elif isinstance(out, dict):
                out[value] = None
            else:
                out.append(value)
    m = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^,\[\]{}:]|:(?=\S))*""").match(s, i)
    return _scalar(m[0]), m.end()


def read_yaml(text: str):
    """The first document; an empty one is an empty map."""
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
    indent = lambda s: len(s) - len(s.lstrip(" "))
    blank = lambda s: not _strip(s).strip()
    end = next((i for i, s in enumerate(lines) if s.startswith("...") or (s.startswith("---") and any(not blank(x) and not x.startswith(("%", "---")) for x in lines[:i]))), len(lines))
    lines = ["" if s.startswith("%") else s[3:] if s.startswith("---") else s for s in lines[:end]]

    def skip(i: int) -> int:
        while i < len(lines) and blank(lines[i]):
            i += 1
        return i

    def block_scalar(head: str, i: int, level: int):
        """A literal or folded scalar under a key or dash of the level."""
        body, inner = [], None
        if m := re.search(r"\d", head):
            inner = max(level, 0) + int(m[0])
        while i < len(lines) and (not lines[i].strip() or indent(lines[i]) > level):
            if inner is None and lines[i].strip():
                inner = indent(lines[i])
            body.append(lines[i][inner or 0 :] if lines[i].strip() else "")
            i += 1
        content = "\n".join(body).rstrip("\n")
        if head[0] == ">":
            content = re.sub(r"(?m)(?<=\S)\n(\n*)(?=[^\s])", lambda m: m[1] or " ", content)
        tail = "" if "-" in head or not content else "\n" + "\n" * (len(body) - len("\n".join(body).rstrip("\n").split("\n"))) if "+" in head else "\n"
        return content + tail, i

    def value(rest: str, i: int, level: int):
        """What stands behind a key or dash of the level; i is the next line."""
        rest = re.sub(r"^(?:[&!]\S*\s*)+", "", _strip(rest).strip())
        if re.fullmatch(r"[|>][-+\d]{0,2}", rest):
            return block_scalar(rest, i, level)
        if rest[:1] in ("[", "{"):
            while rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and i < len(lines):
                rest, i = f"{rest} {_strip(lines[i]).strip()}", i + 1
            return _flow(rest)[0], i
        if rest:
            quote = rest[0] if rest[0] in "\"'" else ""
            while i < len(lines) and (quote and not re.fullmatch(r'"(?:[^"\\]|\\.)*"' if quote == '"' else r"'(?:[^']|'')*'", rest) or not quote and not blank(lines[i]) and indent(lines[i]) > level):
                rest, i = f"{rest} {lines[i].strip() if quote else _strip(lines[i]).strip()}", i + 1
            return _scalar(rest), i
        j = skip(i)
        if j < len(lines) and (indent(lines[j]) > level or indent(lines[j]) == level and re.match(r" *-(\s|$)", lines[j]) and not listed(i - 1)):
            return node(j, indent(lines[j]))
        return None, i

    def listed(i: int) -> bool:
        return bool(re.match(r" *-(\s|$)", lines[i]))

    def node(i: int, level: int):
        i = skip(i)
        if listed(i):
            items = []
            while (i := skip(i)) < len(lines) and indent(lines[i]) == level and listed(i):
                rest = lines[i][level + 1 :]
                inner = level + 1 + indent(rest)
                if _KEY.match(_strip(rest).strip()) and rest.strip()[:1] not in "[{":
                    lines[i] = " " * inner + rest.strip()  # a map begins behind the dash
                    item, i = node(i, inner)
                else:
                    item, i = value(rest, i + 1, level)
                items.append(item)
            return items, i
        if not _KEY.match(lines[i].strip()):
            return value(lines[i], i + 1, level - 1)
        out: dict = {}
        while (i := skip(i)) < len(lines) and indent(lines[i]) == level and not listed(i):
            m = _KEY.match(lines[i].strip())
            if not m:
                raise ValueError(f"line {i + 1}: no key")
            out[_scalar(m[1])], i = value(lines[i].strip()[m.end() :], i + 1, level)
        return out, i

    start = skip(0)
    if start >= len(lines):
        return {}
    out, at = node(start, indent(lines[start]))
    if (at := skip(at)) < len(lines):
        raise ValueError(f"line {at + 1}: unexpected indentation")
    return out
