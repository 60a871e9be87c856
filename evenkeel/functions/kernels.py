"""Arrow batch kernels: numpy over blocks of rows that Spark has partitioned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(col) -> np.ndarray:
    """List column of one Arrow batch as a 2-d float64 array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def list_column(x: np.ndarray) -> pa.Array:
    """2-d float array as a list column."""
    rows, width = x.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))


#: Relative error of a product-form distance that a direct difference must settle.
_CLOSE = 1e-11


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances between rows of x and rows of c, by one matrix product.

    The mean of c is taken off first: far from the origin the product form would lose all digits.
    """
    middle = c.mean(0) if len(c) else 0.0
    x, c = x - middle, c - middle
    d = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.maximum(d, 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c (lowest on ties) and its squared distance, for each row of x.

    Where a second row of c is as near, up to the error of the product form, direct differences decide.
    """
    d = squared_distances(x, c)
    own = np.arange(len(x))
    near = d.argmin(1) if len(x) else np.zeros(0, int)
    best = d[own, near]
    middle = c.mean(0)
    scale = ((x - middle) ** 2).sum(1) + ((c - middle) ** 2).sum(1).max()
    unsure = np.flatnonzero((d <= (best + _CLOSE * scale)[:, None]).sum(1) > 1)
    for at in range(0, len(unsure), 1024):
        rows = unsure[at:at + 1024]
        exact = np.stack([((x[rows] - row) ** 2).sum(1) for row in c], 1)
        near[rows] = exact.argmin(1)
        best[rows] = exact.min(1)
    return near, best
