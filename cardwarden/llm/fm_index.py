"""A compressed FM-index over sequences of word numbers, and matching statistics by backward search.

The Burrows-Wheeler transform lies in a wavelet matrix: for each bit of the symbols one bitmap with a count every 64 places.
Beside it are the lengths that neighbours in suffix order have in common, one byte each, held at ``depth``: where a match cannot
be extended they lead to the next shorter one. Words as 32-bit numbers would take more room, as long as there are fewer than 2**15 different ones.
"""

from __future__ import annotations

import numpy as np

_FAN = 64
#: Words of a bitmap between two counts from its start; counts from there fit 16 bits.
_FAR_BITS = 10
_FAR = 1 << _FAR_BITS
_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BELOW = _ONE - np.uint64(1)
_COLUMNS = np.arange(_FAN)


class WaveletMatrix:
    """Occurrences of a symbol before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        n, blocks = len(symbols), len(symbols) // 64 + 1
        counts = np.bincount(symbols, minlength=alphabet)
        for bit in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            one = (symbols >> bit & 1).astype(bool)
            padded = np.zeros(blocks * 64, bool)
            padded[:n] = one
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])
            far = before[::_FAR]
            near = (before - np.repeat(far, _FAR)[:blocks]).astype(np.uint16)
            self.levels.append((bit, words, far, near, n - int(one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        every = np.arange(alphabet)
        self.shift = (first - self._descend(every, np.zeros(alphabet, np.int64))).astype(np.int32)

    def _descend(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, words, far, near, zeros in self.levels:
            cell = place >> 6
            ones = far[cell >> _FAR_BITS] + near[cell] + np.bitwise_count(words[cell] & _BELOW[place & 63])
            place = np.where(symbols & (1 << bit), zeros + ones, place - ones)
        return place

    def follow(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals of one suffix: whether the symbol before it is the given one, and if so the place of the suffix that it begins."""
        left, out, good = np.arange(len(place)), np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        symbols_left = symbols
        for bit, words, far, near, zeros in self.levels:
            cell, within = place >> 6, place & 63
            word = words[cell]
            set_ = (word & _ONE[within]) != 0
            want = (symbols_left & (1 << bit)) != 0
            ones = far[cell >> _FAR_BITS] + near[cell] + np.bitwise_count(word & _BELOW[within])
            place = np.where(want, zeros + ones, place - ones)
            same = set_ == want
            if not same.all():
                left, place, symbols_left = left[same], place[same], symbols_left[same]
        out[left], good[left] = place + self.shift[symbols_left], True
        return good, out

    def extend(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bounds of suffixes become bounds of those with the symbol before them: all smaller symbols, and the occurrences before the place."""
        return self._descend(symbols, place) + self.shift[symbols]

    def nbytes(self) -> int:
        return self.shift.nbytes + sum(words.nbytes + far.nbytes + near.nbytes for _, words, far, near, _ in self.levels)


class FMIndex:
    """Index of segments, which are arrays of numbers from 1, next to one another in ``words``.

    With ``owners`` it also tells which segments hold a match, at a few bytes a word; where any will do, they are not kept.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, depth: int, owners: bool = False):
        self.depth = depth
        self.n = n = len(words) + len(sizes)
        # A zero ends each segment; no streamed word is one.
        text = np.zeros(n, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
        ranks, width = {1: text}, 1
        while width <= depth:
            ranks[2 * width] = self._pair(ranks[width], width)
            width *= 2
        order = np.argsort(ranks.pop(width), kind="stable")
        self.alphabet = int(text.max(initial=0)) + 1
        self.tree = WaveletMatrix(text[order - 1], self.alphabet)
        self.common = self._levels(order, ranks)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes + 1)[order] if owners else None

    @staticmethod
    def _pair(ranks: np.ndarray, shift: int) -> np.ndarray:
        then = np.zeros(len(ranks), np.int64)
        then[: len(ranks) - shift] = ranks[shift:] + 1
        return np.unique(ranks * (then.max(initial=0) + 1) + then, return_inverse=True)[1].astype(np.int64)

    def _levels(self, order: np.ndarray, ranks: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Common lengths of neighbours in suffix order, with a 0 at both ends, and their minima in groups of groups."""
        same = np.zeros(max(self.n - 1, 0), np.int64)
        for width in sorted(ranks, reverse=True):
            a, b = order[:-1] + same, order[1:] + same
            inside = (a < self.n) & (b < self.n)
            equal = ranks[width][np.where(inside, a, 0)] == ranks[width][np.where(inside, b, 0)]
            same += width * (inside & equal)
        level = np.concatenate([[0], np.minimum(same, self.depth), [0]]).astype(np.uint8)
        levels = []
        while True:
            padded = np.full(-(-len(level) // _FAN) * _FAN, 255, np.uint8)
            padded[: len(level)] = level
            levels.append(padded.reshape(-1, _FAN))
            if len(padded) == _FAN:
                return levels
            level = levels[-1].min(axis=1)

    def nbytes(self) -> int:
        """Of the bitmaps, counts and common lengths; owners are apart."""
        return self.tree.nbytes() + sum(x.nbytes for x in self.common)

    def _smaller(self, place: np.ndarray, limit: np.ndarray, left: bool, level: int = 0) -> np.ndarray:
        """The next place, itself included, to the left or right whose common length is below the limit; the ends have 0."""
        rows = self.common[level]
        group, column = place >> 6, place & 63
        out = place.copy()
        off = np.flatnonzero(rows[group, column] >= limit)
        if not len(off):
            return out
        group, column, limit = group[off], column[off, None], limit[off]
        low = (rows[group] < limit[:, None]) & (_COLUMNS <= column if left else _COLUMNS >= column)
        found = low.any(axis=1)
        out[off] = group * _FAN + (_FAN - 1 - low[:, ::-1].argmax(axis=1) if left else low.argmax(axis=1))
        miss = ~found
        if miss.any():
            far = self._smaller(group[miss] + (-1 if left else 1), limit[miss], left, level + 1)
            out[off[miss]] = self._smaller(far * _FAN + (_FAN - 1 if left else 0), limit[miss], left, level)
        return out

    def _widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share the first ``length`` words with those of the interval."""
        root = length == 0
        limit = np.where(root, 1, length)
        lo, hi = self._smaller(lo, limit, True), self._smaller(hi, limit, False)
        return np.where(root, 0, lo), np.where(root, self.n, hi)

    def _extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of the matches with one more word before them, and which are not empty. Most hold one suffix, which takes one rank."""
        one = hi - lo == 1
        a, b, good = np.empty_like(lo), np.empty_like(hi), np.empty(len(lo), bool)
        single, several = np.flatnonzero(one), np.flatnonzero(~one)
        good[single], a[single] = self.tree.follow(symbols[single], lo[single])
        b[single] = a[single] + 1
        signs = symbols[several]
        new = self.tree.extend(np.concatenate([signs, signs]), np.concatenate([lo[several], hi[several]]))
        a[several], b[several] = new[: len(several)], new[len(several) :]
        good[several] = a[several] < b[several]
        return a, b, good

    def statistics(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of segments streamed from their ends, one word a step, all side by side.

        For each word the length, ``depth`` at most, of the longest run of words from there on that the index holds, and the
        interval of the suffixes that begin with it. A match that cannot be extended by a word is cut at its right end, to the
        length that the interval has in common with a neighbour, until it can; one of ``depth`` words loses its last. Numbers beyond the index's alphabet are in none.
        """
        words = np.where(words < self.alphabet, words, 0)
        out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        size, end = sizes[order], ends[order]
        lo, hi, length = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        common = self.common[0].ravel()
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            lo, hi, length = lo[:live], hi[:live], length[:live]
            place = end[:live] - 1 - step
            symbol = words[place]
            unknown = symbol == 0
            lo[unknown], hi[unknown], length[unknown] = 0, self.n, 0
            left = np.flatnonzero(~unknown)
            while len(left):
                signs = symbol[left]
                a, b, good = self._extend(signs, lo[left], hi[left])
                done = left[good]
                grown = np.minimum(length[done] + 1, self.depth)
                a, b = a[good], b[good]
                long = np.flatnonzero(length[done] == self.depth)
                a[long], b[long] = self._widen(a[long], b[long], grown[long])
                lo[done], hi[done], length[done] = a, b, grown
                left = left[~good]
                # An empty match that cannot be extended stays empty.
                left = left[length[left] > 0]
                if len(left):
                    length[left] = np.maximum(common[lo[left]], common[hi[left]])
                    lo[left], hi[left] = self._widen(lo[left], hi[left], length[left])
            for kept, now in zip(out, (length, lo, hi), strict=True):
                kept[place] = now
        return out

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first of the segments that hold each match; equal intervals are looked through once."""
        if not len(lo):
            return np.zeros(0, np.int64)
        each, back = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        each, sizes = each // (self.n + 1), each % (self.n + 1) - each // (self.n + 1)
        starts = np.cumsum(sizes) - sizes
        every = np.arange(sizes.sum()) - np.repeat(starts - each, sizes)
        return np.minimum.reduceat(self.owner[every], starts).astype(np.int64)[back]
