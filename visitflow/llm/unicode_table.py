"""A table of Unicode categories for whole arrays of characters."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


@cache
def categories() -> np.ndarray:
    """The two-letter general category of each code point, as a fixed-width byte string."""
    return np.array([unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)], dtype="S2")


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    major = categories().view("S1").reshape(-1, 2)[:, 0]
    return (major == b"L") | (major == b"M")
