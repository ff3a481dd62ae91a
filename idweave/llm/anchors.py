"""Content-defined anchors: every window of bytes has one, found from the window alone."""

from __future__ import annotations

import numpy as np

from idweave.llm.shingles import BYTE, inverse_powers, mixed, powers

WINDOW = 50
GRAM = 20
_POSITION = np.uint64((1 << 24) - 1)
LONGEST = 1 << 23  #: bytes handled at a time


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: the anchor's hash, first and last window, anchor.

    A window's anchor is its gram of least hash, the leftmost of equals. A run covers bytes from its first window's
    start to its last one's end.
    """
    if len(data) < WINDOW:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(data) > LONGEST:  # runs end at a part's last window
        parts = []
        for at in range(0, len(data) - WINDOW + 1, LONGEST - WINDOW + 1):
            h, first, last, where = anchors(data[at : at + LONGEST])
            parts.append((h, first + at, last + at, where + at))
        return tuple(np.concatenate(x) for x in zip(*parts))
    b = np.frombuffer(data, np.uint8)
    n, inverse = len(b), inverse_powers(len(b))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[b] * powers(n)[:n], out=total[1:])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    key = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    width, have = WINDOW - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    where = (key & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    last = np.append(first[1:], len(where)) - 1
    where = where[first]
    return gram[where], first, last, where
