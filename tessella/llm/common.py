"""What the operators share: written tables (from the library), batches, column names."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.storage import new_path, remove, shared_dir, written  # noqa: F401


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't taken, whatever its letters' case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a piece holds at most so many bytes of the column, or one row."""
    for batch in batches:
        offsets = _offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)


def tidy() -> None:
    """Gives memory that a task has freed back to the machine: Python workers live on, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each row begins; nulls count as empty."""
    if array.null_count:
        array = array.fill_null("")
    offsets = _offsets(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
