"""Vector tables as blocks: what the two vector searches share.

Both searches compare a stated query set with all rows block by block: candidates are dealt
into shards of a bounded number of rows, queries into chunks, and each (shard, chunk) is one
group of bounded size that returns its own few best per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vec_col: str) -> Column:
    """Whether a vector takes part: not null and without null or non-finite components."""
    x = F.col(vec_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~odd


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.empty(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.reshape(-1)))


def best(frame: DataFrame, query_col: str, id_col: str, score_col: str, k: int) -> DataFrame:
    """The k rows of the highest score of each query, ranked from 1, ties to the smaller id."""
    order = Window.partitionBy(query_col).orderBy(F.col(score_col).desc(), F.col(id_col))
    return (frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(query_col, F.col("rank").cast("int").alias("rank"), id_col, score_col))


def ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
