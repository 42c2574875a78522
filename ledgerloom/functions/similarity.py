"""Text similarity: a native upper bound first, the exact ratio only on what survives."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALPHABET = "abcdefghijklmnopqrstuvwxyzåäö0123456789 "


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def histogram(text: Column) -> Column:
    """Character counts over a fixed alphabet, plus the count of all other characters."""
    n = F.length(text)
    counts = [n - F.length(F.replace(text, F.lit(ch), F.lit(""))) for ch in _ALPHABET]
    other = n
    for c in counts:
        other = other - c
    return F.array(*counts, other)


def ratio_bound(hist_a: Column, hist_b: Column, len_a: Column, len_b: Column) -> Column:
    """Upper bound of the similarity ratio from shared characters (never below the ratio)."""
    shared = F.aggregate(F.zip_with(hist_a, hist_b, lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return 2.0 * shared / F.greatest(len_a + len_b, F.lit(1))


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; the earlier voucher's text goes first. Texts that need no comparison are null and count as alike."""
    return pd.Series([1.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
