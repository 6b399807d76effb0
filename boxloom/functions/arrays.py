"""Box arithmetic and pairing over numpy arrays, for operators that stream sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FLAT = 64  # boxes of a group that are paired with all others of it; larger groups are searched along x. Same pairs.


def numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as arrays of doubles, nulls as nan."""
    return [b.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def whole(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns without nulls as arrays of 64-bit integers."""
    return [b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then from start[1], and so on."""
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - n), n)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of boxes in rows of (x, y, w, h), row by row."""
    iw = np.maximum(0.0, np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0]))
    ih = np.maximum(0.0, np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
    return iw * ih


def _area(a: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, a[:, 0] + a[:, 2] - a[:, 0]) * np.maximum(0.0, a[:, 1] + a[:, 3] - a[:, 1])


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union, row by row; 0 where the union is empty, nan where a number is missing."""
    inter = overlap(a, b)
    union = _area(a) + _area(b) - inter
    return np.divide(inter, union, out=np.where(np.isnan(union), np.nan, 0.0), where=union > 0)


def cover(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of a that lies in b."""
    size = a[:, 2] * a[:, 3]
    return np.divide(overlap(a, b), size, out=np.where(np.isnan(size), np.nan, 0.0), where=size > 0)


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows of a and b of which the extents along x may have a part in common; a superset of those that overlap.

    b is searched in order of x, in a strip as wide as its widest box, so boxes that lie elsewhere aren't compared.
    """
    order = np.argsort(b[:, 0], kind="stable")
    x = b[order, 0]
    fine = ~np.isnan(x)
    order, x = order[fine], x[fine]
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = max(0.0, float(np.nanmax(b[:, 2]))) if not np.isnan(b[:, 2]).all() else 0.0
    lo = np.searchsorted(x, a[:, 0] - width, "left")
    hi = np.searchsorted(x, a[:, 0] + np.maximum(a[:, 2], 0.0), "right")
    n = np.where(np.isnan(a[:, 0]) | np.isnan(a[:, 2]), 0, np.maximum(hi - lo, 0))
    return np.repeat(np.arange(len(a)), n), order[spread(lo, n)]
