"""Columns of vectors as matrices, for products inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length over their norms, by length with their places; what is zero, null or not finite is zero, as cosine has it. Null vectors are in none."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    by = {}
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        v = flat.reshape(-1, n) if n and len(flat) == n * len(at) else flat[starts[at][:, None] + np.arange(n)]
        with np.errstate(all="ignore"):
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
        v[~np.isfinite(v).all(1)] = 0.0
        by[int(n)] = at, v
    return by
