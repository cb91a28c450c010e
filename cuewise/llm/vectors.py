"""Vector columns as matrices: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of doubles) for each length of the column's vectors.

    Vectors that are null, empty, or hold a null or non-finite component are left out.
    """
    lists = column.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        matrix = values[offsets[rows][:, None] + np.arange(n)]
        fine = np.isfinite(matrix).all(1)
        if fine.any():
            yield rows[fine], matrix[fine]


def as_lists(matrix: np.ndarray) -> pa.ListArray:
    """Each row of a matrix as a list of doubles."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(matrix, np.float64).ravel()))
