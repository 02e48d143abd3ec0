"""Suffix arrays of byte strings to a fixed depth, common prefixes, and merging by binary search."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """The ``n_bytes`` from each position on as big-endian 64-bit words, a row each; ``data`` is padded."""
    n = -(-n_bytes // 8)
    out = np.zeros((len(at), n), np.uint64)
    for i in range(n_bytes):
        out[:, i // 8] |= data[at + i].astype(np.uint64) << np.uint64(56 - 8 * (i % 8))
    return out


#: Bytes of a string that count common prefixes in one go.
LANE = 96


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as big-endian words, beyond the end zero."""
    w = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] << np.uint64(8 * step) | w[step:]
    return w[: len(data)]


def refine(order: np.ndarray, rank: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of Larsson and Sadakane: sort each unsorted group by the rank of what follows it.

    ``order`` holds positions by ``rank``, which is the place of the last of a group; singles stay.
    """
    at = rank[order]
    alone = np.ones(len(order), bool)
    same = at[1:] == at[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    open_ = np.flatnonzero(~alone)
    if not len(open_):
        return order, rank
    some = order[open_]
    group, follow = rank[some], second[some]
    key = group << 32 | follow + 1  # both are places, so below 2^31
    by = np.argsort(key)
    some, key = some[by], key[by]
    order = order.copy()
    order[open_] = some
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    rank = rank.copy()
    rank[some] = np.repeat(open_[ends], np.diff(ends, prepend=-1))
    return order, rank


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``data`` sorted by the ``depth`` (at least 8) bytes from each on, and their ranks.

    Bytes beyond the end count as zero. The first eight bytes sort as one number; then the depth
    doubles, the last step overlapping to end at ``depth`` exactly.
    """
    n = len(data)
    key = eights(data)
    order = np.argsort(key)
    key = key[order]
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]), n - 1) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(ends, np.diff(ends, prepend=-1))
    sorted_to = 8
    while sorted_to < depth:
        step = min(sorted_to, depth - sorted_to)
        second = np.append(rank[step:], np.full(min(step, n), -1))
        order, rank = refine(order, rank, second)
        sorted_to += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each position in ``order`` with the one before it.

    Kasai's rule: from one position to the next the length falls by one at most. It holds for lengths
    below ``most``, up to which ``order`` is sorted; after a full length counting starts anew, eight
    bytes at a time. Strings begin at ``starts``; all strings, long ones in parts, take their steps side
    by side. Neighbours that differ within eight bytes count as 0.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)
    padded = np.append(data, np.zeros(most + 9, np.uint8))
    eight = eights(padded[:-1])
    out = np.zeros(n, np.int64)
    lengths = np.diff(np.append(starts, n))
    parts = -(-lengths // LANE)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, lengths = np.repeat(starts, parts) + LANE * inner, np.minimum(LANE, np.repeat(lengths, parts) - LANE * inner)
    may = (before >= 0) & (eight[:n] == eight[before])
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        at = starts[:live] + step
        on = may[at]
        h = np.where((held[:live] < most) & on, np.maximum(held[:live] - 1, 0), 0)
        other = before[at]
        grow = np.flatnonzero(on & (h + 8 <= most))
        while len(grow):
            i, j = at[grow] + h[grow], other[grow] + h[grow]
            grow = grow[(np.maximum(i, j) + 8 <= n) & (eight[i] == eight[j])]
            h[grow] += 8
            grow = grow[h[grow] + 8 <= most]
        grow = np.flatnonzero(on & (h < most))
        while len(grow):
            i, j = at[grow] + h[grow], other[grow] + h[grow]
            grow = grow[(i < n) & (j < n) & (padded[i] == padded[j])]
            h[grow] += 1
            grow = grow[h[grow] < most]
        out[place[at]] = h
        held[:live] = h
    return out


def search(base: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row of ``wanted`` the place of the first row of sorted ``base`` that isn't less."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(base), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        left, right = base[mid], wanted[open_]
        less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for c in range(base.shape[1]):
            less |= equal & (left[:, c] < right[:, c])
            equal &= left[:, c] == right[:, c]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]


class Merged:
    """Distinct windows of several shards in order, each with the least owner seen."""

    def __init__(self, words: int):
        self.rows, self.owner = np.zeros((0, words), np.uint64), np.zeros(0, np.int64)

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = search(self.rows, rows)
        hit = at < len(self.rows)
        hit[hit] = (self.rows[at[hit]] == rows[hit]).all(axis=1)
        return at, hit

    def add(self, rows: np.ndarray, owner: np.ndarray) -> None:
        at, hit = self.find(rows)
        self.owner[at[hit]] = np.minimum(self.owner[at[hit]], owner[hit])
        self.rows = np.insert(self.rows, at[~hit], rows[~hit], axis=0)
        self.owner = np.insert(self.owner, at[~hit], owner[~hit])


def least_owners(strings: list[bytes], owners: list[int], width: int, shard_bytes: int = 2 << 20) -> list[np.ndarray]:
    """For every window of ``width`` bytes of each string, the least owner of any string that holds it.

    Strings are dealt into shards of about ``shard_bytes``. Each gets a suffix array; neighbours whose
    common prefix reaches ``width`` hold the same window. Shards meet by binary search of their
    distinct windows in the merged ones.
    """
    shards, held, size = [], [], 0
    for i, s in enumerate(strings):
        held.append(i)
        size += len(s)
        if size >= shard_bytes:
            shards.append(held)
            held, size = [], 0
    if held:
        shards.append(held)
    merged, found = Merged(-(-width // 8)), []
    for shard in shards:
        lengths = np.array([len(strings[i]) for i in shard], np.int64)
        data = np.frombuffer(b"".join(strings[i] for i in shard), np.uint8)
        starts = np.cumsum(lengths) - lengths
        windows = np.ones(len(data), bool)
        for back in range(1, width):
            windows[(starts + lengths - back)[lengths >= back]] = False
        order, _ = suffix_array(data, width)
        new = common_prefixes(data, order, starts, width) < width
        kinds, positions = np.cumsum(new), order[windows[order]]
        kinds = kinds[windows[order]]
        new = np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        owner = np.repeat(np.array([owners[i] for i in shard], np.int64), lengths)[positions]
        least, rows = np.minimum.reduceat(owner, first) if len(first) else owner, None
        if len(shards) > 1:
            rows = words_at(np.append(data, np.zeros(8, np.uint8)), positions[first], width)
            merged.add(rows, least)
        found.append((positions, group, least, rows, len(data), starts, lengths))
    out: list[np.ndarray] = []
    for positions, group, own, rows, n, starts, lengths in found:
        least = np.full(n, -1, np.int64)
        if len(positions):
            least[positions] = (own if rows is None else merged.owner[merged.find(rows)[0]])[group]
        out += [least[s : s + max(0, m - width + 1)] for s, m in zip(starts.tolist(), lengths.tolist(), strict=True)]
    return out
