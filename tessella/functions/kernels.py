"""The same functions over matrices, for use inside Arrow operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .columns import breakpoints


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None, kind: type = np.float64) -> np.ndarray:
    """A column of lists of equal length, as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, width or 0), kind)


def usable(table: pa.Table | pa.RecordBatch, width: int) -> tuple[pa.Table | pa.RecordBatch, np.ndarray]:
    """Rows whose column values is neither null nor holds null or infinite values, and these as a matrix; another width is an error."""
    table = table.filter(table.column("values").is_valid())
    if pc.any(pc.not_equal(pc.list_value_length(table.column("values")), width)).as_py():
        raise ValueError(f"every series must have {width} values")
    values = matrix(table.column("values"), width)
    whole = np.isfinite(values).all(axis=1)
    return (table, values) if whole.all() else (table.filter(pa.array(whole)), values[whole])


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def paa(values: np.ndarray, segments: int) -> np.ndarray:
    return values.reshape(len(values), segments, -1).mean(axis=2) if values.size else np.zeros((len(values), segments))


def sax(means: np.ndarray, bits: int) -> np.ndarray:
    out = np.searchsorted(np.array(breakpoints(1 << bits)), means, side="left")
    return np.where(np.isnan(means), 0, out).astype(np.int32)


def edges(bits: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.array(breakpoints(1 << bits))
    return np.concatenate([[-np.inf], cuts]), np.concatenate([cuts, [np.inf]])


def bounds(means: np.ndarray, low: np.ndarray, high: np.ndarray, scale: float) -> np.ndarray:
    """Lower bounds: queries' means (q x w) against ranges (n x w each) -> q x n, a segment at a time."""
    out = np.zeros((len(means), len(low)))
    for s in range(means.shape[1]):
        m = means[:, s, None]
        gap = np.maximum(np.maximum(low[None, :, s] - m, m - high[None, :, s]), 0)
        out += gap * gap
    return out * scale


def node_ranges(word: np.ndarray, kept: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    lows, highs = edges(bits)
    shift = bits - kept
    return lows[word << shift], highs[((word + 1) << shift) - 1]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by differences, in pieces; products would lose digits for near series."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 22) // max(1, x.size))
    for at in range(0, len(q), step):
        d = q[at : at + step, None, :] - x[None, :, :]
        out[at : at + step] = np.einsum("qnl,qnl->qn", d, d)
    return out


def paired_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    d = a - b
    return np.einsum("nl,nl->n", d, d)
