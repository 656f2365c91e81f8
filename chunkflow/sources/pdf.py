"""PDF files: pages of files as rows, and documents of styled blocks as files.

The writer embeds TrueType fonts whole, with a map back to Unicode, so any text that the fonts have glyphs for can be
written, searched and read again. Without font files it uses the standard Times fonts, which know Windows-1252 only;
a text with other characters is then an error, never a replacement.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FontOptions
from ..operators.layout import PAGE_SIZES
from ..schemas import PAGES
from .pdf_reader import page_texts
from .truetype import TrueType

#: Width of a character of the standard fonts, about, in thousandths of the font size.
ABOUT = 500
#: Letters that stay together at a word's ends when it is divided.
LEAST = 3
SOFT = "\u00ad"


def read_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] = page_texts) -> DataFrame:
    """One row per page of the PDF files under path; the file's path is the document's id."""

    def split(it: Iterator[pd.DataFrame]):
        for f in it:
            for name, data in zip(f["path"], f["content"]):
                texts = reader(data)
                yield pd.DataFrame({"doc_id": [name] * len(texts), "page_no": range(len(texts)), "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(split, PAGES)


class _Standard:
    """A standard font: Windows-1252, all characters about as wide."""

    def __init__(self, name: bytes):
        self.name = name

    def width(self, text: str) -> float:
        return ABOUT * len(text) / 1000

    def shown(self, text: str) -> bytes:
        try:
            return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252")) + b")"
        except UnicodeEncodeError as e:
            raise ValueError(f"the standard fonts have no {text[e.start : e.end]!r}; name TrueType files in FontOptions") from None

    def objects(self, first: int) -> list[bytes]:
        return [b"<</Type/Font/Subtype/Type1/BaseFont/%s/Encoding/WinAnsiEncoding>>" % self.name]


class _Embedded:
    """A TrueType file, embedded; remembers the glyphs that are used."""

    def __init__(self, data: bytes, name: bytes):
        self.font, self.name, self.used = TrueType(data), name, {}

    def _glyph(self, c: str) -> int:
        if c not in self.font.glyphs:
            raise ValueError(f"the font {self.name.decode()} has no {c!r}")
        self.used[c] = self.font.glyphs[c]
        return self.used[c]

    def width(self, text: str) -> float:
        return sum(self.font.width(self._glyph(c)) for c in text) / 1000

    def shown(self, text: str) -> bytes:
        return b"<" + b"".join(b"%04X" % self._glyph(c) for c in text) + b">"

    def objects(self, first: int) -> list[bytes]:
        f, data = self.font, zlib.compress(self.font.data)
        glyphs = sorted({g: c for c, g in self.used.items()}.items())
        widths = b" ".join(b"%d[%d]" % (g, f.width(g)) for g, _ in glyphs)
        chars = [b"<%04X><%s>" % (g, c.encode("utf-16-be").hex().upper().encode()) for g, c in glyphs]
        parts = [chars[i : i + 100] for i in range(0, len(chars), 100)]
        cmap = b"/CIDInit/ProcSet findresource begin 12 dict begin begincmap/CMapType 2 def 1 begincodespacerange<0000><FFFF>endcodespacerange\n"
        cmap += b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(p), b"\n".join(p)) for p in parts) + b"endcmap end end"
        return [
            b"<</Type/Font/Subtype/Type0/BaseFont/%s/Encoding/Identity-H/DescendantFonts[%d 0 R]/ToUnicode %d 0 R>>" % (self.name, first + 1, first + 4),
            b"<</Type/Font/Subtype/CIDFontType2/BaseFont/%s/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>/FontDescriptor %d 0 R/CIDToGIDMap/Identity/W[%s]>>" % (self.name, first + 2, widths),
            b"<</Type/FontDescriptor/FontName/%s/Flags 4/FontBBox[%d %d %d %d]/ItalicAngle 0/Ascent %d/Descent %d/CapHeight %d/StemV 80/FontFile2 %d 0 R>>" % (self.name, *f.box, f.ascent, f.descent, f.ascent, first + 3),
            b"<</Length %d/Length1 %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(data), len(f.data), data),
            b"<</Length %d>>stream\n%s\nendstream" % (len(cmap), cmap),
        ]


@functools.cache
def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _fonts(font: FontOptions) -> dict[str, _Standard | _Embedded]:
    """The option files of both styles must be readable on all executors."""
    pick = lambda path, name: _Embedded(_file(path), b"CF" + name) if path else _Standard(b"Times-" + name)
    return {"regular": pick(font.regular_font_style, b"Roman"), "bold": pick(font.bold_font_style, b"Bold")}


def divisions(word: str) -> list[int]:
    """Places where a word may be divided: soft hyphens, behind hyphens, and between two consonants among vowels.

    LEAST letters stay on either side.
    """
    vowel = lambda c: c.lower() in "aeiouyəıöüäéèêàâîôûëïáíóúæøå"
    out = [i + 1 for i, c in enumerate(word) if c in (SOFT, "-")]
    out += [i for i in range(LEAST, len(word) - LEAST + 1) if word[i - 2 : i + 2].isalpha() and vowel(word[i - 2]) and not vowel(word[i - 1]) and not vowel(word[i]) and vowel(word[i + 1])]
    return sorted({i for i in out if LEAST <= i <= len(word) - LEAST})


def _lines(text: str, font, size: float, room: float, indent: float, hyphenate: bool) -> list[list[str]]:
    """Lines as lists of words, greedily filled; a word without any place to divide it is cut where the line ends."""
    wide = lambda s: font.width(s.replace(SOFT, "")) * size
    lines, line, used, space = [], [], indent, wide(" ")
    todo = text.split()[::-1]
    while todo:
        word = todo.pop()
        gap = space if line else 0.0
        if used + gap + wide(word) <= room:
            line.append(word.replace(SOFT, ""))
            used += gap + wide(word)
            continue
        mark = lambda i: "" if word[i - 1] == "-" else "-"  # noqa: B023, E731
        fits = [i for i in (divisions(word) if hyphenate else []) if used + gap + wide(word[:i] + mark(i)) <= room]
        if not fits and not line:
            n = next((k for k in range(len(word), 1, -1) if used + wide(word[:k]) <= room), 1)
            line, rest = [word[:n].replace(SOFT, "")], word[n:]
        elif fits:
            line.append((word[: fits[-1]] + mark(fits[-1])).replace(SOFT, ""))
            rest = word[fits[-1] :]
        else:
            rest = word
        if rest:
            todo.append(rest)
        lines.append(line)
        line, used = [], 0.0
    return [*lines, line] if line or not lines else lines


def document(blocks: list[dict], font: FontOptions = FontOptions()) -> bytes:
    """A PDF of styled blocks (text, font, font_size, align, indent, space_before, space_after, leading, hyphenate)."""
    width, height = PAGE_SIZES.get(font.page_size.strip().upper(), PAGE_SIZES["A4"])
    m, fonts = font.margins, _fonts(font)
    pages: list[list[bytes]] = [[]]
    y = height - m.top
    for b in blocks:
        size, f, room = b["font_size"], fonts["bold" if b["font"] == "bold" else "regular"], width - m.left - m.right
        lines = _lines(b["text"], f, size, room, b["indent"], bool(b.get("hyphenate")))
        y -= b["space_before"]
        for k, line in enumerate(lines):
            if y - size < m.bottom:
                pages.append([])
                y = height - m.top
            y -= size * b["leading"]
            indent = b["indent"] if k == 0 else 0
            free = room - indent - f.width(" ".join(line)) * size
            x = m.left + (max(0, free / 2) if b["align"] == "center" else indent)
            spread = free / (len(line) - 1) / size * 1000 if b["align"] == "justified" and isinstance(f, _Embedded) and k < len(lines) - 1 and len(line) > 1 else 0
            words = [f.shown(w + (" " if i < len(line) - 1 else "")) for i, w in enumerate(line)]
            text = b"[" + (b" %.1f " % -spread).join(words) + b"]TJ" if spread else f.shown(" ".join(line)) + b"Tj"
            pages[-1].append(b"BT/%s %.2f Tf %.2f %.2f Td %s ET" % (b"F2" if b["font"] == "bold" else b"F1", size, x, y, text))
        y -= b["space_after"]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b""]
    names = []
    for label, style in ((b"F1", "regular"), (b"F2", "bold")):
        names.append(b"/%s %d 0 R" % (label, len(objects) + 1))
        objects += fonts[style].objects(len(objects) + 1)
    kids = []
    for p in pages:
        content = zlib.compress(b"\n".join(p))
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(content), content))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Contents %d 0 R/Resources<</Font<<%s>>>>>>" % (width, height, len(objects), b"".join(names)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(kids))
    out, at = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def documents(styled: DataFrame, font: FontOptions = FontOptions(), writer: Callable = document) -> DataFrame:
    """doc_id and the PDF of its styled blocks; one document is in memory at a time."""
    cols = ["line_no", "text", "font", "font_size", "align", "indent", "space_before", "space_after", "leading", "hyphenate"]
    rows = styled.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("blocks"))

    def run(it):
        for f in it:
            yield pd.DataFrame({"doc_id": f["doc_id"], "pdf": [writer([r if isinstance(r, dict) else r.asDict() for r in b], font) for b in f["blocks"]]})

    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, pdf binary")
