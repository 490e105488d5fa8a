"""Words of whole texts, cut from their UTF-8 bytes without a pattern engine.

A word is a longest run of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case only. In UTF-8 all
bytes beyond ASCII belong to such characters, so one translation table and a split at spaces give exactly these runs.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa

_KEPT = (string.digits + string.ascii_letters).encode() + bytes(range(128, 256))
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
SLICE_BYTES = 1 << 20


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def word_slices(blob: bytes, step: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in order, a slice of about ``step`` bytes at a time, so that no list grows with one very long text."""
    if len(blob) <= step:
        yield blob.translate(TABLE).split()
        return
    spaced, start = blob.translate(TABLE), 0
    while start < len(spaced):
        end = spaced.find(b" ", start + step)
        end = len(spaced) if end < 0 else end
        yield spaced[start:end].split()
        start = end
