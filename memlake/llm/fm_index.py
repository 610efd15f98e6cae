"""A bidirectional FM-index over a set of words, and the search for words that are one edit away."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Queries that are searched together.
TOGETHER = 1 << 14


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The suffixes of a delimited text (0 before, between and after the words) in order.

    Delimiters count as different: the last is the least, then they follow as they lie. A suffix so is settled by the end of its word,
    and the k-th word of a sorted list begins after the delimiter of rank k + 1. Ranks are doubled until all differ.
    """
    size = len(codes)
    ends = np.flatnonzero(codes == 0)
    rank = codes.astype(np.int64) + len(ends)
    rank[ends] = np.arange(1, len(ends) + 1)
    rank[ends[-1]] = 0
    step = 1
    while True:
        ahead = np.zeros(size, dtype=np.int64)
        ahead[: size - step] = rank[step:]
        key = rank * (size + int(codes.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        if new.all():
            return order
        rank[order] = np.cumsum(new) - 1
        step *= 2


class FMIndex:
    """Backward search in one direction: the Burrows-Wheeler transform of the delimited words in a wavelet matrix.

    Every level of the matrix holds, for each place, how many zeros come before it, so a rank is one look-up a bit.
    """

    def __init__(self, words: list[str], symbols: np.ndarray):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        codes = np.searchsorted(symbols, text)
        last = codes[suffix_order(codes) - 1]  # the symbol before each suffix; before the first is the last delimiter
        self.size, self.levels = len(codes), max(1, int(len(symbols) - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(symbols)))])
        self.zeros = np.zeros((self.levels, self.size + 1), dtype=np.int32)
        for level in range(self.levels):
            bit = (last >> (self.levels - 1 - level)) & 1
            np.cumsum(bit == 0, out=self.zeros[level, 1:])
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.bottom = np.zeros(len(symbols), dtype=np.int64)
        self.bottom = self.extend(np.arange(len(symbols)), np.zeros(len(symbols), dtype=np.int64), np.zeros(len(symbols), dtype=np.int64))[0] - self.before[:-1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (low, count) with one more symbol: the new low and count, and how many of the interval go on with a lesser symbol."""
        a, b, lesser = low, low + count, np.zeros(len(low), dtype=np.int64)
        for level in range(self.levels):
            zeros = self.zeros[level]
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            lesser += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        return self.before[symbol] + a - self.bottom[symbol], b - a, lesser

    def branches(self, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols that intervals go on with: (which interval, symbol, new low, new count, how many go on with a lesser symbol)."""
        which, symbol, a, b = np.arange(len(low)), np.zeros(len(low), dtype=np.int64), low, low + count
        lesser = np.zeros(len(low), dtype=np.int64)
        for level in range(self.levels):
            zeros = self.zeros[level]
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            oa, ob = zeros[-1] + a - za, zeros[-1] + b - zb
            none, some = zb > za, ob > oa
            which = np.concatenate([which[none], which[some]])
            symbol = np.concatenate([symbol[none] << 1, symbol[some] << 1 | 1])
            lesser = np.concatenate([lesser[none], lesser[some] + (zb - za)[some]])
            a, b = np.concatenate([za[none], oa[some]]), np.concatenate([zb[none], ob[some]])
        return which, symbol, self.before[symbol] + a - self.bottom[symbol], b - a, lesser


class TwoWayIndex:
    """Two FM-indexes, of the words and of the words read backwards, whose intervals are kept in step.

    An interval is (active, count, passive): the lower ends in the index of the search's direction and in the other. When the active
    one goes on with a symbol, the passive one moves past those that go on with a lesser one. words must be sorted and all different.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.symbols = np.unique(np.frombuffer(("\0" + "".join(words)).encode("utf-32-le"), dtype=np.uint32))
        self.forward = FMIndex(words, self.symbols)
        self.backward = FMIndex(sorted(w[::-1] for w in words), self.symbols)

    def one_edit(self, asked: np.ndarray, exact: np.ndarray, longer: np.ndarray, rightward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in `asked`, words found): the words that are one edit away from words (by number), with one part the same.

        A search scheme of two: rightward, the first `exact` characters are matched exactly, from the word's beginning on, and the search goes on to
        the right with one error; otherwise the last `exact` ones, and it goes on to the left. Where `longer`, the word found has one
        character fewer; elsewhere as many, or one more. Each word is found once: of equal neighbours the last is inserted or deleted.
        """
        for start in range(0, len(asked), TOGETHER):
            part = slice(start, start + TOGETHER)
            for at, found in self._search(asked[part], exact[part], longer[part], rightward):
                yield start + at, found

    def _search(self, asked: np.ndarray, exact: np.ndarray, longer: np.ndarray, rightward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        index = self.backward if rightward else self.forward
        texts = [self.words[k] if rightward else self.words[k][::-1] for k in asked]
        ends = np.cumsum([len(t) for t in texts])
        begin, length = ends - np.array([len(t) for t in texts]), np.array([len(t) for t in texts])
        codes = np.searchsorted(self.symbols, np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32))

        def go_on(symbol, active, count, passive):
            active, count, lesser = index.extend(symbol, active, count)
            return active, count, passive + lesser

        def finish(row, at, active, count, passive):
            """Match the rest of words that have had their error, then the delimiter."""
            while len(row):
                over = at == length[row]
                symbol = np.where(over, 0, codes[np.minimum(begin[row] + at, len(codes) - 1)])
                active, count, passive = go_on(symbol, active, count, passive)
                found = over & (count > 0)
                if found.any():
                    yield row[found], (passive if rightward else active)[found] - 1  # the delimiter's rank names the word
                going = ~over & (count > 0)
                row, at, active, count, passive = row[going], at[going] + 1, active[going], count[going], passive[going]

        row = np.arange(len(asked))
        active, count, passive = go_on(np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64), np.full(len(row), index.size), np.zeros(len(row), dtype=np.int64))
        at = np.zeros(len(row), dtype=np.int64)
        while len(row):
            more = count > 1  # an interval of one is the word itself
            row, at, active, count, passive = row[more], at[more], active[more], count[more], passive[more]
            over = at >= length[row]
            here = np.where(over, 0, codes[np.minimum(begin[row] + at, len(codes) - 1)])
            erring = np.flatnonzero(at >= exact[row])
            deletes = erring[longer[row[erring]] & ~over[erring]]
            after = begin[row[deletes]] + at[deletes] + 1
            deletes = deletes[(after == begin[row[deletes]] + length[row[deletes]]) | (codes[np.minimum(after, len(codes) - 1)] != here[deletes])]
            yield from finish(row[deletes], at[deletes] + 1, active[deletes], count[deletes], passive[deletes])
            grows = erring[~longer[row[erring]]]
            which, symbol, low, n, lesser = index.branches(active[grows], count[grows])
            of = grows[which]
            other = (symbol != 0) & ((symbol != here[of]) | over[of])
            of, symbol, low, n, moved = of[other], symbol[other], low[other], n[other], (passive[of] + lesser)[other]
            yield from finish(row[of], at[of], low, n, moved)  # inserted
            inside = ~over[of]
            yield from finish(row[of][inside], at[of][inside] + 1, low[inside], n[inside], moved[inside])  # replaced
            on = ~over
            row, at = row[on], at[on] + 1
            active, count, passive = go_on(here[on], active[on], count[on], passive[on])
