"""Blocks to styled paragraphs; look-ups of names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FontOptions
from .structure import effective_kind

#: Page sizes in points.
PAGE_SIZES = {"A3": (842, 1191), "A4": (595, 842), "A5": (420, 595), "LETTER": (612, 792), "LEGAL": (612, 1008)}


def styled(blocks: DataFrame, font: FontOptions = FontOptions()) -> DataFrame:
    """Adds effective_kind, font_size, font, align, indent, space_before, space_after, leading and hyphenate."""
    b = blocks.withColumn("effective_kind", effective_kind(F.col("kind"), F.col("text")))
    pick = lambda h1, h2, p: F.when(F.col("effective_kind") == "H1", h1).when(F.col("effective_kind") == "H2", h2).otherwise(p)
    size = float(font.font_size)
    return b.select(
        *b.columns,
        pick(F.lit(size * 1.6), F.lit(size * 1.3), F.lit(size)).alias("font_size"),
        pick(F.lit("bold"), F.lit("bold"), F.lit("regular")).alias("font"),
        pick(F.lit("center"), F.lit("left"), F.lit("justified")).alias("align"),
        pick(F.lit(0.0), F.lit(0.0), F.lit(float(font.first_line_indent))).alias("indent"),
        pick(F.lit(float(font.space_before) + 8), F.lit(float(font.space_before) + 6), F.lit(0.0)).alias("space_before"),
        pick(F.lit(float(font.space_after) + 10), F.lit(float(font.space_after) + 6), F.lit(0.0)).alias("space_after"),
        F.lit(float(font.leading_multiplier)).alias("leading"),
        pick(F.lit(False), F.lit(False), F.lit(True)).alias("hyphenate"),
    )


def page_size(name: Column) -> Column:
    """Known name of a page size; anything else is A4."""
    known = F.upper(F.trim(name))
    return F.when(known.isin(*PAGE_SIZES), known).otherwise("A4")


def parsed_name(value: Column, names: Iterable[str], default: str) -> Column:
    """The name that the value spells, whatever its case, or the default."""
    out = F.lit(default)
    for n in names:
        out = F.when(F.lower(F.trim(value)) == n.lower(), n).otherwise(out)
    return out
