"""Per-code-point tables for vectorised text features."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a letter, is upper case, lower-case code point or 0 for what is no letter), by code point."""
    n = sys.maxunicode + 1
    alpha = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    upper = np.fromiter((chr(i).isupper() for i in range(n)), bool, n)
    lower = np.fromiter((ord(chr(i).lower()[0]) if alpha[i] else 0 for i in range(n)), np.int64, n)
    return alpha, upper, lower


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
