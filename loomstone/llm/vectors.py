"""Quantised vectors of Arrow batches, as whole numbers in doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def quantised(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x)) of a column of lists, once for each number of components.

    Components count as doubles. Null lists and lists with a null, infinite or
    not-a-number component are left out.
    """
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        m = flat.reshape(-1, n) if n and len(rows) == len(size) else flat[at[rows][:, None] + np.arange(n)]
        finite = np.isfinite(m).all(axis=1)
        yield rows[finite], np.floor(m[finite] * scale)


def require_exact(m: np.ndarray, limit: float) -> None:
    """Sums of products of components within the limit are exact in doubles; anything beyond is an error, never a wrong figure."""
    if m.size and not np.abs(m).max() <= limit:
        raise ValueError(f"a scaled component is beyond {limit:.0f}: products would not be exact in doubles; use a smaller scale")
