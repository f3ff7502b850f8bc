"""Arrow batches in small pieces, so that Python holds no more than a few megabytes of rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: A step over an Arrow batch takes at most so many rows and, unless one row has more, bytes of
#: it. The JVM ends batches at spark.sql.execution.arrow.maxBytesPerBatch, so both sides are bounded.
SLICE_ROWS = 256
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of SLICE_ROWS rows and SLICE_BYTES bytes at most."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * n // max(1, batch.nbytes)))
        while at < n:
            piece = batch.slice(at, step)
            while piece.num_rows > 1 and piece.nbytes > 2 * SLICE_BYTES:
                piece = piece.slice(0, piece.num_rows // 2)
            yield piece
            at += piece.num_rows
