"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement (numpy, for one task's shards)."""

from __future__ import annotations

import numpy as np


class Shard:
    """Rotations of a byte string in order of at least their first 64 bytes, and the two bytes before each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        wide = np.concatenate([data] * (1 + -(-8 // max(1, n))) if n < 8 else [data, data[:8]])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | wide[k : k + n].astype(np.uint64)
        depth = 8
        while True:
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
            if depth >= 64:
                break
            key = (rank.astype(np.uint64) << np.uint64(32)) | np.roll(rank, -depth).astype(np.uint64)
            depth *= 2
        self.order = order
        self.before = (data[(order - 2) % n].astype(np.uint16) << 8) | data[(order - 1) % n]


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all shards' rotations in merged order: their place in the shards' orders laid end to end, and their common prefix.

    The interleaving begins as one shard after another. Each pass reads the shards' transforms in the interleaved order,
    puts every rotation behind the two bytes before it and deals stably by those bytes, which refines the interleaving
    from the first k bytes to k + 2. Two neighbours are in one interval as long as their bytes and the rotations they
    came from agree; the pass that parts them tells how long a prefix each has in common with the one before, in steps
    of two bytes and ``depth`` at most. No suffix is sorted again.
    """
    sizes = [len(s.order) for s in shards]
    before = np.concatenate([s.before for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    interval, parted = np.zeros(len(z), np.int32), np.zeros(len(z), bool)
    prefix = np.full(len(z), depth, np.int16)
    prefix[:1] = 0
    place = np.arange(len(z))
    for k in range(0, depth, 2):
        read = before[place]
        deal = np.argsort(read, kind="stable")
        z, came, read = z[deal], interval[deal], read[deal]
        known, parted = parted, np.concatenate([[False], (read[1:] != read[:-1]) | (came[1:] != came[:-1])])
        interval = np.cumsum(parted, dtype=np.int32)
        prefix[parted & ~known] = k
        if len(shards) == 1:
            continue
        place = np.empty(len(z), np.int64)
        for j in range(len(shards)):
            own = np.flatnonzero(z == j)
            place[own] = start[j] + np.arange(len(own))
    return place, prefix


def intervals(data: np.ndarray, cuts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of data in order of their first ``depth`` bytes, and the interval of equal ones that each is in.

    data is cut into shards at ``cuts``; positions less than depth bytes before a cut see bytes from their shard's start.
    """
    parts = [p for p in np.split(data, cuts) if len(p)]
    shards = [Shard(p) for p in parts]
    place, prefix = merged(shards, depth)
    offset = np.cumsum([0, *map(len, parts)])
    at = np.concatenate([s.order + off for s, off in zip(shards, offset)])
    return at[place], np.cumsum(prefix < depth) - 1
