"""Evaluate a value once for several uses inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with one evaluation of ``value``.

    A parse or pattern match used twice would otherwise be copied into the plan
    twice, and nested uses multiply.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
