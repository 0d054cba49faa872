"""Weighted similarity of two short texts, 0 to 100: the best of whole, partial and word-wise comparison, each with its weight."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Of the longest common subsequence, with a row of bits for each sign."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & (1 << len(a)) - 1
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """The shorter against its best window in the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(ratio(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long)))


def by_words(a: str, b: str, compare) -> float:
    """Words in order, and the shared words against either rest."""
    x, y = set(a.split()), set(b.split())
    ordered = compare(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if not x or not y:
        return ordered
    if both and (not one or not two):
        return 100.0
    first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
    return max(ordered, compare(first, second), *((compare(both, first), compare(both, second)) if both else ()))


def similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < 1.5:
        return max(best, 0.95 * by_words(a, b, ratio))
    scale = 0.9 if apart <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * by_words(a, b, partial))


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


def score(a: Column | str, b: Column | str) -> Column:
    """An Arrow function; only for distinct pairs within a block."""
    return F.pandas_udf(_scores, "double")(a, b)
