"""String ratios for candidate pairs: Arrow UDFs over bit-parallel longest common subsequences.

They belong behind native filters: join on keys first, score what is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big integer stands for a row of the table."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float:
    """1 less the insertions and deletions between two strings over their lengths; 0 if one is missing or empty."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def _sorted(s: str | None) -> str:
    return " ".join(sorted((s or "").split()))


def partial(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows at the ends being cut."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    return max(indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(_sorted(x), _sorted(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial(x, y) for x, y in zip(a, b)], dtype="float64")
