"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.trim(c, F.lit(WHITESPACE))


def last_segment(path: Column) -> Column:
    """Last segment of a ``/`` path that ends with no ``/``."""
    return F.substring_index(F.rtrim(trim_ws(path), F.lit("/")), "/", -1)


def known_leaf(leaf: Column) -> Column:
    """The segment; empty, missing or ``(not set)`` -> ``unknown``."""
    return F.when(leaf.isNull() | leaf.isin("", "(not set)"), F.lit("unknown")).otherwise(leaf)


def last_leaf(category: Column) -> Column:
    """Last non-empty segment of a ``/`` path; empty or ``(not set)`` -> ``unknown``."""
    return known_leaf(last_segment(category))
