"""What a PDF needs to know of a TrueType font file: glyphs of characters, their widths, and the font's measures."""

from __future__ import annotations

import struct


class TrueType:
    def __init__(self, data: bytes):
        self.data = data
        count = struct.unpack_from(">H", data, 4)[0]
        self.tables = {data[12 + 16 * i : 16 + 16 * i].decode("latin-1"): struct.unpack_from(">II", data, 20 + 16 * i) for i in range(count)}
        if "glyf" not in self.tables:
            raise ValueError("only TrueType outlines can be embedded")
        head, hhea = self._at("head"), self._at("hhea")
        self.units = struct.unpack_from(">H", data, head + 18)[0]
        self.box = [self._scaled(x) for x in struct.unpack_from(">4h", data, head + 36)]
        self.ascent, self.descent = (self._scaled(x) for x in struct.unpack_from(">2h", data, hhea + 4))
        n = struct.unpack_from(">H", data, hhea + 34)[0]
        self._advances = struct.unpack_from(">" + "Hh" * n, data, self._at("hmtx"))[::2]
        self.glyphs = self._characters()

    def _at(self, table: str) -> int:
        return self.tables[table][0]

    def _scaled(self, x: int) -> int:
        return round(1000 * x / self.units)

    def width(self, glyph: int) -> int:
        """In thousandths of the font size."""
        return self._scaled(self._advances[min(glyph, len(self._advances) - 1)])

    def _characters(self) -> dict[str, int]:
        at, out = self._at("cmap"), {}
        tables = [struct.unpack_from(">HHI", self.data, at + 4 + 8 * i) for i in range(struct.unpack_from(">H", self.data, at + 2)[0])]
        for platform, encoding, offset in tables:
            if (platform, encoding) not in ((0, 3), (0, 4), (0, 6), (3, 1), (3, 10)):
                continue
            sub, kind = at + offset, struct.unpack_from(">H", self.data, at + offset)[0]
            if kind == 12:
                for i in range(struct.unpack_from(">I", self.data, sub + 12)[0]):
                    first, last, glyph = struct.unpack_from(">III", self.data, sub + 16 + 12 * i)
                    out |= {chr(c): glyph + c - first for c in range(first, last + 1)}
            elif kind == 4:
                n = struct.unpack_from(">H", self.data, sub + 6)[0] // 2
                column = lambda k, form="H": struct.unpack_from(f">{n}{form}", self.data, sub + 14 + 2 * n * k + (2 if k else 0))  # noqa: B023, E731
                for i, (last, first, delta, where) in enumerate(zip(column(0), column(1), column(2), column(3))):
                    for c in range(first, last + 1):
                        glyph = c
                        if where:
                            glyph = struct.unpack_from(">H", self.data, sub + 16 + 6 * n + 2 * i + where + 2 * (c - first))[0]
                        if c != 0xFFFF and (glyph or not where):
                            out.setdefault(chr(c), (glyph + delta) & 0xFFFF)
        return {c: g for c, g in out.items() if g}
