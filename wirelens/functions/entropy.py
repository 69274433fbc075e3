"""Shannon entropy of byte strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.numbers import round_half_up


def batch_entropy(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits per byte of each of the byte strings laid end to end in ``data``; 0 when empty."""
    rows = len(sizes)
    if rows == 1:  # a long text by itself needs no row index per byte
        cells = np.bincount(data, minlength=256)
        return _entropy_of(cells, sizes, rows)
    owner = np.repeat(np.arange(rows, dtype="int64"), sizes)
    return _entropy_of(np.bincount(owner * 256 + data, minlength=rows * 256), sizes, rows)


def _entropy_of(cells: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    hit = np.flatnonzero(cells)
    counts = cells[hit].astype("float64")
    n = np.maximum(sizes, 1).astype("float64")
    share = counts / n[hit // 256]
    return np.bincount(hit // 256, weights=-share * np.log2(share), minlength=rows) + 0.0


# one histogram pass takes at most this many rows (x 256 cells) and, beyond one row, bytes
_ROWS = 4096
_BYTES = 4 << 20


def _passes(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges that respect both limits."""
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, done + _BYTES, side="right"))
        to = min(max(to, at + 1), at + _ROWS)
        out.append((at, to))
        at = to
    return out


@F.arrow_udf(T.DoubleType())
def _entropy_udf(payload: pa.Array) -> pa.Array:
    payload = payload.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(payload.buffers()[1], dtype="int64")[
        payload.offset:payload.offset + len(payload) + 1]
    raw = payload.buffers()[2]
    data = np.frombuffer(raw, dtype="uint8") if raw is not None else np.empty(0, dtype="uint8")
    sizes = np.diff(offsets)
    out = [batch_entropy(data[offsets[a]:offsets[b]], sizes[a:b]) for a, b in _passes(sizes)]
    return pa.array(np.concatenate(out) if out else np.empty(0), type=pa.float64())


def byte_entropy(payload: Column | str) -> Column:
    """Entropy of a binary column, rounded to 2 decimals; empty and null give 0.

    A payload is counted where it lies, one histogram pass per Arrow batch. Exploding it into one
    row per byte would multiply the data by its length before the first aggregation.
    """
    payload = F.col(payload) if isinstance(payload, str) else payload
    return round_half_up(_entropy_udf(payload), 2)
