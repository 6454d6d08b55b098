"""Shared plumbing of the corpus operators: scratch tables (of ``entwine.scratch``) and Arrow text access."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from entwine.scratch import Scratch as Scratch
from entwine.scratch import scratch_root as scratch_root
from entwine.scratch import scratch_scope as scratch_scope

#: Rows of a batch that a task works on at once; longer ones are cut.
BATCH_ROWS = 2000


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a partition; what it held goes back to the system, as Python workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(s, BATCH_ROWS) for b in batches for s in range(0, max(1, b.num_rows), BATCH_ROWS))
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` column names, each led by as many underscores as it takes to differ from ``taken`` (case aside)."""
    lower = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in lower:
            name = f"_{name}"
        out.append(name)
    return out


def partitions_for(spark: SparkSession, n_bytes: int, per_task: int = 64 << 20) -> int:
    """Shuffle partitions so that a task holds about ``per_task`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-int(n_bytes) // per_task))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying it; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte, so every multi-byte character, is unchanged."""
    out = data.copy()
    up = (out >= 65) & (out <= 90)
    out[up] |= 0x20
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
