"""Similarity of names: 1 - indel distance / total length, with a JVM-side prefilter."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    bits: dict[str, int] = {}
    for i, c in enumerate(a):
        bits[c] = bits.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & bits.get(c, 0)
        row = (row + u | row - u) & full
    lcs = len(a) - row.bit_count()
    return 2.0 * lcs / (len(a) + len(b))


def matcher_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def similarity(a: Column, b: Column, how: str = "indel") -> Column:
    """The similarity of two columns as an Arrow UDF; put near_enough() before it."""
    ratio = {"indel": indel_ratio, "matcher": matcher_ratio}[how]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.array([np.nan if p is None or q is None else ratio(p, q) for p, q in zip(x, y)], dtype=float))

    return run(a, b)


def near_enough(a: Column, b: Column, least: float) -> Column:
    """Necessary for similarity(a, b) >= least, and computed in the JVM: the edit distance is at most the indel distance."""
    most = F.floor((1.0 - least) * (F.length(a) + F.length(b)) + 1e-9)
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)
