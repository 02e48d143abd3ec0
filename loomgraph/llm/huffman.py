"""Canonical length-limited Huffman codes over integer symbols, in numpy."""

from __future__ import annotations

import numpy as np

#: A lane is a run of ids with a bit offset of its own; lanes decode side by side.
LANE = 128


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of at most ``limit`` bits with the least total, by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    for _ in range(limit):
        levels.append(row if not levels else merged_is_leaf)  # noqa: F821
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        at = np.argsort(both, kind="stable")
        row, merged_is_leaf = both[at], at < len(leaves)
    levels[0] = np.ones(len(leaves), bool)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """The canonical code of given lengths: shorter first, equal lengths in order of the symbol."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = np.asarray(symbols, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.width = int(self.lengths[-1]) if len(order) else 1
        spans = np.left_shift(1, self.width - self.lengths)
        starts = np.concatenate(([0], np.cumsum(spans)[:-1])) if len(order) else np.zeros(0, np.int64)
        self.codes = starts >> (self.width - self.lengths)
        size = int(self.symbols.max(initial=0)) + 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.symbols], self.length_of[self.symbols] = self.codes, self.lengths
        self._table = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit offset of every lane."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        size = self.length_of[ids]
        ends = np.cumsum(size)
        at = ends - size
        word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
        moved = self.code_of[ids] << shift
        n = int(ends[-1] + 31 >> 5) + 1
        out = np.bincount(word, (moved >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (moved & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
        return out.astype(np.uint32).astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], at[::LANE].astype(np.uint32)

    def decode(self, bits: bytes, lanes: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a stream: a table look-up gives each lane its next id, all lanes at once."""
        if not n:
            return np.zeros(0, np.uint32)
        if self._table is None:
            spans = np.left_shift(1, self.width - self.lengths)
            rest = (1 << self.width) - int(spans.sum())
            self._table = np.append(np.repeat(self.symbols, spans), np.zeros(rest, np.int64)).astype(np.uint32), np.append(np.repeat(self.lengths, spans), np.ones(rest, np.int64))
        symbol, length = self._table
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint64)
        window = data[:-4] << np.uint64(32)  # the five bytes from each byte on
        for i, by in ((1, 24), (2, 16), (3, 8), (4, 0)):
            window |= data[i : len(data) - 4 + i] << np.uint64(by)
        at, out = lanes.astype(np.int64), np.zeros((len(lanes), LANE), np.uint32)
        full, last = (n - 1) // LANE, n - (n - 1) // LANE * LANE
        mask, down = (1 << self.width) - 1, 40 - self.width
        for step in range(LANE):
            live = at if step < last else at[:full]
            if not len(live):
                break
            entry = (window[live >> 3].astype(np.int64) >> (down - (live & 7))) & mask
            out[: len(live), step] = symbol[entry]
            live += length[entry]
        return out.reshape(-1)[:n]
