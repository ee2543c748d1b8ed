"""Vectors of a table's rows as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, matrix of doubles) for each length among the rows whose id is not null
    and whose vector is neither null nor empty and has finite components only."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[known & (sizes > 0)]):
        rows = np.flatnonzero(known & (sizes == size))
        matrix = flat[starts[rows][:, None] + np.arange(size)]
        finite = np.isfinite(matrix).all(axis=1)
        if finite.any():
            yield rows[finite], matrix[finite]
