"""Text primitives with Unicode semantics, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware splitting sees it; Java's \s is ASCII only.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters, numbers and the underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Peeled off a question's words before they are looked up.
EDGES = ".,!?;:'\"()"
TABLE_BLOCK = r"(?s)(\[TABLE\].*?\[/TABLE\])"
_MARK = "\u0001"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def split_words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def tokens(c: Column) -> Column:
    """Lower-cased word runs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def peel(c: Column) -> Column:
    """Without edge punctuation."""
    return F.regexp_replace(F.regexp_replace(c, "^[.,!?;:'\"()]+", ""), "[.,!?;:'\"()]+$", "")


def sentences(c: Column) -> Column:
    """Sentences of a page; a [TABLE] block is one of them, whole.

    A part that begins with [TABLE] but never ends is one too. Sentences end before
    white space that follows . ! or ?; a line's end alone does not end one.
    """
    parts = F.split(F.regexp_replace(c, TABLE_BLOCK, f"{_MARK}$1{_MARK}"), _MARK)
    # pieces of a stripped part have no white space at their ends
    plain = lambda p: F.filter(F.split(strip(p), f"(?<=[.!?]){WS}+"), lambda s: s != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("[TABLE]")), F.array(strip(p))).otherwise(plain(p))))
