"""A full-text index of word numbers in minute space, built by numpy over one shard of a table.

The suffixes of the shard are sorted by prefix doubling, the last column of the sorted rotations is kept as a wavelet
matrix with rank counts, and every SAMPLE-th suffix position is stored. Many phrases are searched at once, from their
last word to their first; places are found by walking back to the next stored position.
"""

from __future__ import annotations

import numpy as np

#: Distance of stored suffix positions.
SAMPLE = 16
#: The word number of separators and of words that no phrase contains.
GAP = 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in sorted order; every gap counts as a letter of its own, so no match crosses one."""
    n = len(symbols)
    gaps = symbols == GAP
    n_gaps = int(gaps.sum())
    key = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + n_gaps)
    order = np.argsort(key, kind="stable")
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = 1
    while True:
        last = np.empty(n, bool)
        last[-1] = True
        last[:-1] = first[1:]
        open_at = np.flatnonzero(~(first & last))  # places in `order` whose group has several suffixes
        if not len(open_at):
            return order
        at = order[open_at]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        head = rank[at]
        resorted = np.lexsort((after, head))
        at, after, head = at[resorted], after[resorted], head[resorted]
        order[open_at] = at
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        first[open_at] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_at, 0))
        width *= 2


class FMIndex:
    """The index of one shard. `symbols` are word numbers from 1, GAP between texts."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        symbols = np.append(symbols.astype(np.int32), np.int32(GAP))
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size + 1))))
        self.bits = max(1, int(size).bit_length())
        self.counts, self.zeros = [], []
        level = last
        for b in range(self.bits - 1, -1, -1):
            ones = (level >> b) & 1
            self.counts.append(np.concatenate(([0], np.cumsum(ones, dtype=np.int32))))
            self.zeros.append(int(len(level) - ones.sum()))
            level = np.concatenate((level[ones == 0], level[ones == 1]))
        stored = (order % SAMPLE == 0) | (last == GAP)
        self.stored, self.stored_rank, self.places = stored, np.cumsum(stored) - 1, order[stored]

    def _rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs in the last column before each end."""
        base, ends = np.zeros(len(symbol), np.int64), list(ends)
        for k, (ones, zeros) in enumerate(zip(self.counts, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            base, *ends = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (base, *ends))
        return [x - base for x in ends]

    def _symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.counts, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a matrix with one phrase a row: (row, position) of every occurrence in the shard."""
        row = np.arange(len(phrases))
        low, high = self.starts[phrases[:, -1]], self.starts[phrases[:, -1] + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            open_ = low < high
            row, low, high = row[open_], low[open_], high[open_]
            if not len(row):
                break
            symbol = phrases[row, column].astype(np.int64)
            low, high = (self.starts[symbol] + x for x in self._rank(symbol, low, high))
        found = low < high
        row, low, high = row[found], low[found], high[found]
        size = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.repeat(row, size), self.locate(at)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Shard positions of the suffixes at these places of the sorted order."""
        at = at.astype(np.int64)
        out, steps, todo = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(todo):
            here = self.stored[at]
            out[todo[here]] = self.places[self.stored_rank[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbol = self._symbol(at)
                at = self.starts[symbol] + self._rank(symbol, at)[0]
            steps += 1
        return out
