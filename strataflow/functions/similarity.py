"""String similarities as vectorised functions: normalised indel, token sort, token set, matching blocks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step a character."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return (row ^ full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); two empty strings are alike."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and the shared tokens with what each side has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    out = indel_ratio(left, right)
    return max(out, indel_ratio(both, left), indel_ratio(both, right)) if both else out


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _vectorised(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def udfs() -> dict:
    """The functions by name, made when a session exists."""
    return {f.__name__: _vectorised(f) for f in (indel_ratio, token_sort_ratio, token_set_ratio, sequence_ratio)}


def register(spark) -> None:
    """Make the functions known to SQL."""
    for name, f in udfs().items():
        spark.udf.register(name, f)
