"""Numeric coercion and scalar transforms.

Spark's own casts accept spellings such as ``1d`` that are not numbers in the
data, and raise under ANSI mode; every text coercion is guarded by a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.text import trim_ws

NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
GROUPED_DIGITS = r"(?<=\d)_(?=\d)"


def text_to_double(c: Column) -> Column:
    """Number in a text, anything else null."""
    t = trim_ws(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def text_to_long(c: Column) -> Column:
    """Whole number in a text (``1.0`` counts), anything else null."""
    t = trim_ws(c)
    d = text_to_double(c)
    # Most texts are plain whole numbers and need neither trimming nor the long pattern.
    return F.when(c.rlike("^-?[0-9]{1,18}$"), c.try_cast("bigint")).when(
        t.rlike(NUMBER), F.coalesce(t.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint")))
    )


def to_double(c: Column, dtype: T.DataType) -> Column:
    """Coerce a column of any scalar type to double; bad values and NaN become null."""
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
    elif isinstance(dtype, T.BooleanType):
        return c.cast("double")
    else:
        d = text_to_double(c.cast("string"))
    return nan_to_null(d)


def to_long(c: Column, dtype: T.DataType) -> Column:
    """Coerce to a nullable whole number; fractional values become null."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c.cast("bigint")
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
        return F.when(d == F.floor(d), d.try_cast("bigint"))
    return text_to_long(c.cast("string"))


def float_or_zero(text: Column) -> Column:
    """Float of a text, 0 when it is not one; digits may be grouped by ``_``."""
    # Most texts are plain whole numbers and need no pattern.
    return F.coalesce(
        text.try_cast("bigint").cast("double"),
        text_to_double(F.regexp_replace(text, GROUPED_DIGITS, "")),
        F.lit(0.0),
    )


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def log1p_floor(c: Column) -> Column:
    """log(1 + x) with missing and negative values taken as 0."""
    return F.log1p(F.greatest(F.coalesce(nan_to_null(c), F.lit(0.0)), F.lit(0.0)))


def log1p_capped(c: Column, cap: float) -> Column:
    """log(1 + min(x, cap)) with missing and negative values taken as 0."""
    return log1p_floor(F.least(F.coalesce(nan_to_null(c), F.lit(0.0)), F.lit(float(cap))))


def clip(c: Column, bound: float) -> Column:
    """Missing -> 0, then limit to [-bound, bound]; infinities end on the bound."""
    x = F.coalesce(nan_to_null(c), F.lit(0.0))
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))
