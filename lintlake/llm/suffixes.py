"""Suffix sorting of bytes: a difference cover, one block of suffixes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes that are compared before the cover decides, and its period.
PERIOD = 32


def difference_cover(period: int) -> np.ndarray:
    """Residues of which two always differ by any given residue: 0 to s-1 and every s-th from then on, s near the root."""
    step = int(period**0.5)
    return np.unique(np.concatenate([np.arange(step), np.arange(2 * step - 1, period + step, step) % period]))


def shifts(period: int, cover: np.ndarray) -> np.ndarray:
    """`[i, j]`: the smallest shift that brings residues i and j both into the cover."""
    inside = np.zeros(period, bool)
    inside[cover] = True
    table = np.full((period, period), -1, np.int64)
    for shift in range(period - 1, -1, -1):
        hit = inside[(np.arange(period) + shift) % period]
        table[np.ix_(hit, hit)] = shift
    assert (table >= 0).all()
    return table


class SuffixBlocks:
    """The order of chosen suffixes of `data`, by at least their first `2 * PERIOD` bytes; after its end come zeros.

    The suffixes at positions of the cover are ranked first.  The others are sorted one block at a time: by their
    first `PERIOD` bytes, and those still equal by the ranks at the nearest positions where both meet the cover.
    Memory is that of the data, the ranks and one block, however long the repeats are.
    """

    def __init__(self, data: np.ndarray, period: int = PERIOD):
        self.period = period
        self.size = len(data)
        self.data = np.concatenate([data, np.zeros(4 * period, np.uint8)])
        cover = difference_cover(period)
        self.shift = shifts(period, cover)
        sample = (np.arange(0, self.size + 2 * period, period)[:, None] + cover).ravel()
        sample = sample[sample < self.size + period]
        self.rank = np.zeros(self.size + 3 * period, np.int64)
        self.rank[sample] = 1 + self._names(sample)
        # Twice the depth: the name of a place and of the place a period on, which is in the cover too.
        pairs = self.rank[sample] * (len(sample) + 2) + self.rank[sample + period]
        _, deeper = np.unique(pairs, return_inverse=True)
        self.rank[sample] = deeper

    def words(self, at: np.ndarray, word: int) -> np.ndarray:
        """Eight bytes from the given word of each suffix on, as a number in the order of the bytes."""
        view = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))
        return view[at + 8 * word].astype(np.uint64)

    def _names(self, at: np.ndarray) -> np.ndarray:
        """Numbers in the order of the first `period` bytes, equal for equal ones."""
        keys = [self.words(at, w) for w in range(self.period // 8)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), np.int64)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        names = np.empty(len(at), np.int64)
        names[order] = np.cumsum(new)
        return names

    def blocks(self, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """The suffixes at `at`, sorted, in blocks of one or more first byte pairs, up to `most` where one is no longer."""
        first = self.words(at, 0) >> np.uint64(48)
        counts = np.bincount(first.astype(np.int64), minlength=1 << 16)
        start, held = 0, 0
        for pair in np.append(np.flatnonzero(counts), 1 << 16):
            count = counts[pair] if pair < 1 << 16 else most
            if held and held + count > most:
                yield self._sorted(at[(first >= start) & (first < pair)])
                start, held = pair, 0
            held += count

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        keys = [self.words(at, w) for w in range(self.period // 8)]
        order = np.lexsort(keys[::-1])
        tied = np.ones(len(at), bool)
        tied[0] = False
        for key in keys:
            tied[1:] &= key[order][1:] == key[order][:-1]
        at = at[order]
        member = tied.copy()
        member[:-1] |= tied[1:]
        places = np.flatnonzero(member)
        group = np.cumsum(~tied[places])
        # Each tied group is split by its first member into those before, equal and after, until all are equal.
        while len(places):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            pivot = at[places[new]][np.cumsum(new) - 1]
            here = at[places]
            shift = self.shift[here % self.period, pivot % self.period]
            side = np.sign(self.rank[here + shift] - self.rank[pivot + shift])
            split = np.lexsort((side, group))
            at[places] = here[split]
            group, side = group[split], side[split]
            parts = np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
            group = np.cumsum(parts)
            left = (side != 0) & (np.bincount(group)[group] > 1)
            places, group = places[left], group[left]
        return at


def same_start(blocks: SuffixBlocks, ordered: np.ndarray, length: int) -> np.ndarray:
    """Whether each of the ordered suffixes begins with the same `length` bytes as the one before it."""
    same = np.ones(len(ordered), bool)
    same[:1] = False
    for word in range(-(-length // 8)):
        key = blocks.words(ordered, word)
        over = 8 * (word + 1) - length
        if over > 0:
            key >>= np.uint64(8 * over)
        same[1:] &= key[1:] == key[:-1]
    return same
