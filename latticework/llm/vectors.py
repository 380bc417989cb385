"""Whole-number vectors for the exact searches: preparation in Spark, matrices and exact products in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Scaled components stay below this, so that products of vectors of up to 512 components fit a long.
LARGEST = 1 << 27


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null, not finite or out of range."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    good = ~F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return F.when(good, F.transform(F.when(good, scaled), lambda x: F.floor(x).cast("int")))


def prepared(rows: DataFrame, label: str, vector: str = "v") -> tuple[DataFrame, int, int]:
    """Rows whose vector is not null, filled with 0 to the longest one, stored; their number and the length."""
    rows = materialise(rows.where(F.col(vector).isNotNull()), label)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    filled = F.concat(vector, F.array_repeat(F.lit(0), F.lit(width or 0) - F.size(vector)))
    return rows.withColumn(vector, filled), n, width or 0


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type).to_numpy()
    return flat.astype(np.int64).reshape(n, -1 if len(flat) else 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: floating point where it is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def first_k(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each owner, ties to smaller ids."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return order[rank < k]


def no_rows(**kinds: pa.DataType) -> pa.Table:
    """What a cell without rows on one side gives."""
    return pa.table({c: pa.array([], t) for c, t in kinds.items()})
