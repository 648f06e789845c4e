"""Vector tables as numpy blocks (used by operators 4 and 8).

Usable vectors have an id and only finite components.  A vector shorter than the
longest counts as zero in the missing components.  Rows that repeat an id count
once, with the smallest vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): one usable vector of doubles per id."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(~bad)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def dimension(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a (n, width) array of doubles, zero where a list is short."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
