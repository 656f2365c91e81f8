"""String expressions: white space, lengths in UTF-16 units, normalisation, clean-up of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and characters of words, as Java and RE2 classes.
WS = r"[\t\n\x0B\f\r\x85\p{Z}]"
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
#: Letters that a number is kept apart from, and capitals that open a sentence.
LETTERS = "A-Za-zƏÖÜĞİŞÇəöüğişç"
CAPITALS = "A-ZƏÖÜĞİŞÇ"
#: Fixed value: hyphens that end a line within a word.
HYPHENS = "‐‑‒–-"


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's own trim knows only the space)."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def trim_left(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+", "")


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(F.regexp_replace(c, rf"{WS}+", "") == "", F.lit(True))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def preprocess(raw: Column) -> Column:
    """Text of extracted pages as running paragraphs; blank text is returned as it is, untrimmed.

    Line ends, control characters, words hyphenated at line ends, single line breaks, runs of breaks and of spaces,
    numbers glued to letters and sentences glued together, in this order; then trimmed.
    """
    c = unix_lines(raw)
    for pattern, new in (
        (r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", ""),
        (rf"({WORD})[{HYPHENS}]\n({WORD})", "$1$2"),
        (r"(?<!\n)\n(?!\n)", " "),
        (r"\n{3,}", "\n\n"),
        (r"[ \t]{2,}", " "),
        (rf"(?<=\P{{Nd}})(\p{{Nd}}{{1,3}})(?=[{LETTERS}])", "$1 "),
        (rf"(?md)^(\p{{Nd}}{{1,3}})(?=[{LETTERS}])", "$1 "),
        (rf"([.!?])(?=[{CAPITALS}])", "$1 "),
    ):
        c = F.regexp_replace(c, pattern, new)
    return F.when(is_blank(raw), raw).otherwise(trim(c))


def normalize(text: Column, strip_empty_lines: bool = True) -> Column:
    """Unix line ends, at most two empty lines in a row if asked for, trimmed. Null stays null."""
    c = unix_lines(text)
    return trim(F.regexp_replace(c, r"\n{4,}", "\n\n\n") if strip_empty_lines else c)


def sanitize_output(text: Column) -> Column:
    """Model output without one code fence around it; blank output is returned as it is."""
    c = F.regexp_replace(unix_lines(text), rf"\A{WS}*```[a-zA-Z]*{WS}*\n", "")
    return F.when(is_blank(text), text).otherwise(trim(F.regexp_replace(c, rf"\n{WS}*```{WS}*\z", "")))
