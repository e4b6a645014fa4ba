"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a page's end in extracted text, and the characters that end a line.
PAGE_BREAK = r"<<<PAGE_BREAK ([0-9]+)>>>"
LINE_END = "[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
BLANK_LINE = "\\n\\s*\\n"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    """A token for each four characters, at least one, none for empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def word_bag(c: Column) -> Column:
    """Distinct lower-cased Unicode words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words; 0 if either bag is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def paragraphs(c: Column, sep: str = BLANK_LINE) -> Column:
    return F.split(F.coalesce(c, F.lit("")), sep, -1)


def sentences(c: Column, sep: str = BLANK_LINE) -> Column:
    """Stripped sentences of each paragraph, without empty ones; a sentence ends before an ASCII capital, digit or bracket."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), PAGE_BREAK, "\n")
    each = F.transform(F.split(flat, sep, -1), lambda p: F.split(p, r"(?<=[.!?])\s+(?=[A-Z0-9(])", -1))
    return F.filter(F.transform(F.flatten(each), strip), lambda s: s != "")
