"""An FM-index over whole numbers (numpy): suffix order, wavelet matrix with ranks, backward search, sampled positions.

Symbol 0 ends a segment; phrases hold none. Every segment's start is sampled, so no walk back leaves its segment.
"""

from __future__ import annotations

import io

import numpy as np

RATE = 16  #: every so many places of a segment are sampled


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of text in the order of the suffixes from there; ends of segments differ and rank by place.

    Prefix doubling: only places that still have equals are sorted again, by what follows at twice the distance.
    """
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()) - 1)
    key = rank << 32
    key[:-1] |= rank[1:]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 2
    open_ = ~(new & np.append(new[1:], True))
    slots = np.flatnonzero(open_)
    while len(slots):
        at = order[slots]
        key = (rank[at] << 32) | rank[at + depth]
        deal = np.argsort(key, kind="stable")
        at, key = at[deal], key[deal]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def packed_bits(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits) >> 6) + 1, np.uint64)
    small = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(small)] = small
    return out


class Bits:
    """Bits with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FmIndex:
    def __init__(self, n: int, symbols: int, levels: np.ndarray, marks: np.ndarray, sampled: np.ndarray, first: np.ndarray):
        self.n, self.symbols = int(n), int(symbols)
        self.stored = {"n": n, "symbols": symbols, "levels": levels, "marks": marks, "sampled": sampled, "first": first}
        self.levels = [Bits(w) for w in levels]
        self.zeros = [self.n - int(b.before[-1]) for b in self.levels]
        self.marks, self.sampled, self.first = Bits(marks), sampled, first
        every = np.arange(symbols)
        self.base = self.down(np.zeros(symbols, np.int64), every)

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> FmIndex:
        """The index of text, whose last symbol is 0, over ``symbols`` symbols."""
        order = suffix_order(text)
        place = np.arange(len(text))
        start = np.concatenate([[True], text[:-1] == 0])
        offset = place - np.maximum.accumulate(np.where(start, place, 0))
        marks = (offset % RATE == 0)[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        row, levels = text[order - 1], []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            one = (row >> bit) & 1 != 0
            levels.append(packed_bits(one))
            row = np.concatenate([row[~one], row[one]])
        return cls(len(text), symbols, np.array(levels), packed_bits(marks), order[marks].astype(np.int32), first)

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.stored)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> FmIndex:
        return cls(**np.load(io.BytesIO(data)))

    def down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places of the transform's first ``at`` rows' ends among equal symbols, through all levels."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            set_ = (symbol >> (len(self.levels) - 1 - k)) & 1 != 0
            at = np.where(set_, zeros + ones, at - ones)
        return at

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one place earlier; the symbol there is not 0."""
        at, symbol = rows, np.zeros(len(rows), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            ones, set_ = bits.rank(at), bits.get(at)
            symbol = symbol * 2 + set_
            at = np.where(set_, zeros + ones, at - ones)
        return self.first[symbol] + at - self.base[symbol]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows from and to of the suffixes that begin with each phrase: symbols at the right of its row, none of them 0."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((length > k) & (low < high))
            symbol = phrases[live, phrases.shape[1] - 1 - k]
            low[live], high[live] = (self.first[symbol] + self.down(x[live], symbol) - self.base[symbol] for x in (low, high))
        return low, np.maximum(low, high)

    def located(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes of rows, by walking back to a sampled one."""
        out, left, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            here = self.marks.get(rows)
            out[left[here]] = self.sampled[self.marks.rank(rows[here])] + walked
            rows, left = self.back(rows[~here]), left[~here]
            walked += 1
        return out
