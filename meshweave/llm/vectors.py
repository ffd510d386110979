"""Vectors as numpy blocks, for the nearest-neighbour operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec (array<double>) of rows whose vector is not null or empty and has only finite components.

    A row without id takes no part either, since a result could not name it.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(key).cast("bigint").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one common length as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int, repeated: bool = False) -> np.ndarray:
    """Positions of the k largest scores, larger first, ties to the smaller id.

    ``repeated``: ids may occur more than once; each then counts once, with its best score.
    """
    if repeated:
        order = np.lexsort((ids, -scores))
        first = np.unique(ids[order], return_index=True)[1]
        return order[np.sort(first)[:k]]
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
        return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
    return np.lexsort((ids, -scores))[:k]
