"""Arrow arrays of a UDF in slices, so that what Python holds of a batch does not grow with it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sliced(batches: Iterable[pa.Array | tuple[pa.Array, ...]], rows: int = 64, size: int = 1 << 20) -> Iterator[tuple[list, ...]]:
    """Columns of strings as Python lists, of at most so many rows and, but for a single row, so many bytes at a time."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        at = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(at + rows, max(at + 1, to))
            yield tuple(c.slice(at, to - at).to_pylist() for c in columns)
            at = to
