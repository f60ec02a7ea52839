"""Placeholder texts that stand for missing, unknown or other values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitflow.functions.text import trim_ws

# Texts that mean missing, unknown and other.
NONE_VALUES = ["", " ", "(not provided)", "None", "not available in demo dataset"]
UNKNOWN_VALUES = ["(not set)", "Unknown", "not set", "unknown", "unknown.unknown"]
OTHER_VALUES = ["(Other)"]


def is_none(c: Column) -> Column:
    t = trim_ws(c)
    return c.isNull() | t.isin(NONE_VALUES) | (F.lower(t) == "none")


def is_unknown(c: Column) -> Column:
    t = trim_ws(c)
    return F.coalesce(t.isin(UNKNOWN_VALUES) | F.lower(t).isin("unknown", "not set"), F.lit(False))


def is_other(c: Column) -> Column:
    return F.coalesce(trim_ws(c).isin(OTHER_VALUES), F.lit(False))


def is_reserved(c: Column) -> Column:
    """The value has a reserved index and takes no vocabulary slot."""
    return is_none(c) | is_unknown(c) | is_other(c)
