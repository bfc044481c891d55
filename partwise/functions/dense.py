"""Small NumPy helpers for Arrow kernels: sparse rows to dense blocks."""

from __future__ import annotations

import numpy as np

CHUNK_CELLS = 4_000_000


def row_chunks(n_rows: int, n_columns: int):
    """Slices of rows whose dense block stays near 32 MB."""
    step = max(1, CHUNK_CELLS // max(1, n_columns))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def dense_block(idx, val, n_columns: int) -> np.ndarray:
    """Dense rows from sequences of index and value arrays; indices past the width are unseen features."""
    block = np.zeros((len(idx), n_columns))
    if len(idx):
        rows = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
        columns = np.concatenate([np.asarray(i, dtype=np.int64) for i in idx])
        values = np.concatenate([np.asarray(v, dtype=float) for v in val])
        seen = columns < n_columns
        block[rows[seen], columns[seen]] = values[seen]
    return block


def squared_distances(block: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = (block * block).sum(1)[:, None] - 2.0 * block @ points.T + (points * points).sum(1)[None, :]
    return np.maximum(out, 0.0, out=out)
