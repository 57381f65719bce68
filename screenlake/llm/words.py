"""Words and shingles of whole texts as numpy arrays.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D.  Texts are handled as UTF-8
bytes: these separators never occur inside a longer character.  Long texts go through in
segments that overlap by one word less than a shingle, so memory does not follow their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def normalised(raw: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each word starts and ends in that."""
    codes = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    space = _SPACE[codes]
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]
    first = np.argmin(space) if len(space) else 0
    keep[:first] = False
    out = codes[keep]
    gaps = np.flatnonzero(space[keep])
    if len(gaps):
        out = out.copy()
        out[gaps] = 0x20
    if not len(out):
        return out, gaps, gaps
    return out, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(out)]])


def segments(data: bytes, size: int, limit: int = SEGMENT) -> Iterator[bytes]:
    """Parts of ``data`` that together hold every run of ``size`` words exactly once."""
    at, room = 0, limit
    while at + room < len(data):
        end = at + room
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = data[at:end]
        cut = part.rsplit(None, size - 1)
        if len(cut) < size or not cut[0].strip():
            room *= 2
            continue
        yield part
        at, room = at + len(cut[0]), limit
    yield data[at:]


def shingle_bounds(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each shingle; fewer words than ``size`` make one shingle, none make none."""
    if not len(starts):
        return starts, ends
    n = max(1, len(starts) - size + 1)
    return starts[:n], ends[min(size, len(ends)) - 1 :][:n]
