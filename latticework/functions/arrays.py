"""List columns of Arrow tables as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)])
    return flat.astype(np.float64).reshape(rows, -1 if len(flat) else 0)

