"""Label functions as Spark expressions, and partial ratio as a pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize(x: Column) -> Column:
    """lower case; every run of other than a-z and 0-9 becomes one space; no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def normalize_label(x: Column) -> Column:
    """lower case without white space at the ends; null becomes ''."""
    return F.coalesce(F.regexp_replace(F.lower(x), r"(?U)^\s+|\s+$", ""), F.lit(""))


def join_labels(labels: Column) -> Column:
    """labels with a space between; null or empty gives ''."""
    return F.coalesce(F.array_join(labels, " "), F.lit(""))


def tokens(x: Column) -> Column:
    """Distinct tokens of a normalised text; '' has none."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    """of the sets of tokens; 0 for two empty ones."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def shared_tokens(a: Column, b: Column) -> Column:
    """F6"""
    return F.size(F.array_intersect(a, b))


def token_ratio(a: Column, b: Column) -> Column:
    """shared tokens over the distinct tokens of a."""
    return share(shared_tokens(a, b), F.size(a))


def exact(a: Column, b: Column) -> Column:
    """F7"""
    return (a == b).cast("int")


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """the pair in string order."""
    return F.least(a, b), F.greatest(a, b)


def lcs_length(a: str, masks: dict[str, int], size: int) -> int:
    """Longest common subsequence of a and the text whose places by character are bits of masks."""
    v = full = (1 << size) - 1
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _best_window(short: str, long: str) -> float:
    n, m = len(short), len(long)
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    best = 0.0
    # whole windows, and those cut by the ends of the longer text; a window must end or begin with a character of the shorter
    for start in range(-n + 1, m):
        w = long[max(0, start) : start + n]
        if (w[-1] if start <= 0 else w[0]) not in masks and w[-1] not in masks:
            continue
        most = 200.0 * min(n, len(w)) / (n + len(w))
        if most > best:
            best = max(best, 200.0 * lcs_length(w, masks, n) / (n + len(w)))
            if best == 100.0:
                break
    return best


def partial_ratio_of(a: str | None, b: str | None) -> float:
    """F4, 0 to 100: the best similarity 200 * LCS / (lengths) of the shorter text with a window of the longer.

    Texts of one length are tried both ways; two empty ones are 100, one empty one is 0.
    """
    a, b = a or "", b or ""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if a == b:
        return 100.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    return pd.Series([seen[k] if (k := (x, y)) in seen else seen.setdefault(k, partial_ratio_of(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")
