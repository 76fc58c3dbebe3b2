"""Words of many texts at once, found in their bytes by arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte: 0 inside words, 1 a gap, 2 a break."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)], out[list(breaks)] = 1, 2
    return out


def byte_words(text: pa.Array, kind: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in a row, A-Z lowered; for each its row and the breaks before it. Null has no words."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = kind[raw]
    inside = kind == 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = ends[:-1][np.diff(ends) > 0]
    start[edges] = inside[edges]
    at = np.flatnonzero(start)
    flat = _LOWER[raw[inside]]
    first = np.append(np.cumsum(inside)[at] - 1, len(flat)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(first), pa.py_buffer(flat))
    return words, np.searchsorted(ends, at, side="right") - 1, np.cumsum(kind == 2)[at]
