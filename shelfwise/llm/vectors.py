"""Embedding rows that can take part in a search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id and v (array of doubles): without null ids and vectors, null or non-finite components, empty vectors and,
    unless zero, zero vectors; of several lengths the commonest stays (the shorter on a tie)."""
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        good &= F.exists("v", lambda x: x != 0)
    found = found.where("vec_id is not null and v is not null").where(good)
    width = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.size("v") == (width.n if width else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, length) of a column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to smaller ids, in that order."""
    if len(scores) > k:
        most = np.partition(scores, k - 1)[k - 1]
        at = np.flatnonzero(scores <= most)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], scores[at]))][:k]


def nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, at_once: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (with its own id, which is no candidate) the places and distances of its k nearest rows, ties to smaller ids.

    One matrix product estimates all distances; rows within its error of the k-th estimate are then measured exactly.
    """
    norms, out = (x**2).sum(1), []
    for start in range(0, len(queries), at_once):
        block, block_own = queries[start : start + at_once], own[start : start + at_once]
        sizes = (block**2).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            about = norms[None] - 2 * (block @ x.T) + sizes[:, None]
        error = 1e-14 * (x.shape[1] + 8) * (norms.max(initial=0) + sizes)
        for q, i, estimate, slack in zip(block, block_own, about, error, strict=True):
            other = np.flatnonzero(ids != i)
            seen = estimate[other]
            if len(other) > k and np.isfinite(seen).all() and np.isfinite(slack):
                other = other[seen <= np.partition(seen, k - 1)[k - 1] + 2 * slack]
            d = np.sqrt(((x[other] - q) ** 2).sum(1))
            good = best(d, ids[other], k)
            out.append((other[good], d[good]))
    return out
