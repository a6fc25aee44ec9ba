"""Arrow batches in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a run starts here, rows) of sorted batches: pieces in which the named columns, which hold no null, are equal.
    A run that goes on over a batch's end comes in several pieces, so no run need be held."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in names:
            col = batch.column(c)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(c)[0].as_py() for c in names)
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield k > 0 or first != last, batch.slice(a, b - a)
        last = tuple(batch.column(c)[n - 1].as_py() for c in names)
