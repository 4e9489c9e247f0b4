"""Arrow helpers for functions that run inside tasks."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20


def library_in_one_thread() -> None:
    """Spark's tasks are the parallelism: threads of the tokenizers library would contend with other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def process_cache(name: str, make):
    """One object per worker process; functions of this package are pickled by value, so module globals live per task."""
    home = sys.modules.setdefault("_postmill_process_cache", types.ModuleType("_postmill_process_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def forget_caches(*keep: str) -> None:
    """Give back what other operators keep in this worker; they build it again when they run again."""
    home = vars(sys.modules.get("_postmill_process_cache", types.ModuleType("none")))
    for name in [n for n in home if n not in keep and not n.startswith("__")]:
        del home[name]


def slices(batches, column: str = "text", max_bytes: int = CHUNK_BYTES):
    """Cut record batches into pieces of at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bounds, bytes): row i is ``bytes[bounds[i]:bounds[i + 1]]``; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    flat = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return bounds - bounds[0], flat


def strings(column) -> list[str]:
    """A string column as Python strings; null is empty."""
    return pc.fill_null(column, "").to_pylist()
