"""Checks of a chunk's output, first failure wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_left, utf16_length

#: Beginnings of outputs that talk about the translation.
CHATTER = ["here is", "translation:", "tərcümə:"]


def ratio(given: Column, output: Column) -> Column:
    return utf16_length(output) / F.greatest(F.lit(1), utf16_length(F.coalesce(given, F.lit(""))))


def failure(given: Column, output: Column, min_chars: int = 40, min_ratio: float = 0.30) -> Column:
    """Code of the first failed check: empty, short, ratio, replacement, chatter; null if the output is good."""
    start = F.lower(trim_left(output))
    chatter = F.lit(False)
    for s in CHATTER:
        chatter = chatter | start.startswith(s)
    out = F.when(is_blank(output), "empty").when(utf16_length(output) < min_chars, "short")
    out = out.when(ratio(given, output) < min_ratio, "ratio").when(output.contains("�"), "replacement")
    return out.when(chatter, "chatter")


def reason(given: Column, output: Column, min_chars: int = 40, min_ratio: float = 0.30) -> Column:
    """The failure as a message; null if the output is good."""
    code = failure(given, output, min_chars, min_ratio)
    return (
        F.when(code == "empty", "Empty output.")
        .when(code == "short", f"Output too short (<{min_chars}).")
        .when(code == "ratio", F.format_string("Output/input length ratio too small (%.2f < %.2f).", ratio(given, output), F.lit(min_ratio)))
        .when(code == "replacement", "Output contains Unicode replacement character (�).")
        .when(code == "chatter", "Output contains extra commentary/prefix.")
    )
