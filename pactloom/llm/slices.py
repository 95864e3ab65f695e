"""Arrow batches cut by the bytes of their texts, so that a task holds a bounded part of them as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: int, held: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices whose strings in the column take about `held` bytes at most, or of one row.

    What Arrow no longer needs goes back to the system at the end, since Spark keeps its Python workers for later stages.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column % b.num_columns)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + held, side="right")))
            yield b.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()
