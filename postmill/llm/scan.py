"""Words of many texts at once, found by byte classes over one flat buffer of UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import flat_bytes

WORD, BLANK, BREAK = 0, 1, 2
# A-Z become a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """``codes[i]`` is word i's place in ``distinct``; ``owner[i]`` its text, ``piece[i]`` differs behind a break or a text's end."""

    def __init__(self, column, classes: np.ndarray):
        bounds, flat = flat_bytes(column)
        flat = LOWER[flat]
        kind = classes[flat]
        inside = kind == WORD
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        # Texts lie side by side in the buffer.
        firsts = bounds[:-1][np.diff(bounds) > 0]
        starts[firsts] = inside[firsts]
        ends[firsts[1:] - 1] = inside[firsts[1:] - 1]
        at = np.flatnonzero(starts)
        sizes = np.flatnonzero(ends) + 1 - at
        self.owner = np.searchsorted(bounds, at, side="right") - 1
        self.piece = np.cumsum(kind == BREAK, dtype=np.int32)[at] + self.owner if len(at) else self.owner
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at),
            [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(flat[inside])],
        ).dictionary_encode()
        self.codes = words.indices.to_numpy(zero_copy_only=False)
        self.distinct = words.dictionary
