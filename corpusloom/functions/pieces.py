"""Arrow batches a piece at a time. Spark bounds a batch by its rows and by 64 MB; Python values of a whole one, such as
the ids of its texts, take many times that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes of the texts of one piece, unless a single text is longer.
PIECE_BYTES = 1 << 20


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive pieces of an array of texts: all rows, each in one piece."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, "right")))
        yield at, end - at
        at = end
