"""Arrow batches in slices of bounded text, for functions whose Python objects take many times the bytes of their input."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22


def slices_of(texts: pa.Array) -> list[tuple[int, int]]:
    """Bounds of consecutive rows of some ``SLICE_BYTES`` of text; a longer row stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    number = (np.cumsum(sizes) - 1) // SLICE_BYTES
    firsts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
    return list(zip(firsts, firsts[1:]))


def in_slices(texts: pa.Array, function: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``function`` over slices of ``texts``. A row's result must be its own."""
    parts = [function(texts.slice(a, b - a)) for a, b in slices_of(texts)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
