"""Canonical length-limited Huffman codes, coded and decoded in whole arrays."""

from __future__ import annotations

import numpy as np

LONGEST = 16
#: Ids between two bit-offset checkpoints.
EVERY = 256


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits for each symbol, 0 for those that don't occur, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # A level holds the symbols and the pairs of the level below, by weight; for each place the number of symbols up to it is kept.
    level, upto = weights, []
    for _ in range(longest):
        upto.append(level)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        level = np.sort(np.concatenate([weights, pairs]), kind="stable")
    take, lengths = 2 * (n - 1), np.zeros(n, np.int64)
    for below in range(longest - 1, -1, -1):
        level = upto[below]
        if below:
            previous = upto[below - 1]
            pairs = previous[: len(previous) // 2 * 2].reshape(-1, 2).sum(axis=1)
            # Symbols stand before pairs of the same weight.
            kinds = np.argsort(np.concatenate([weights, pairs]), kind="stable") < n
            symbols = int(kinds[:take].sum())
        else:
            symbols = min(take, n)
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        size = lengths[order].astype(np.int64)
        step = np.left_shift(1, LONGEST - size)
        codes[order] = (np.cumsum(step) - step) >> (LONGEST - size)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        fill = np.left_shift(1, LONGEST - self.lengths[order])
        self.symbol = np.zeros(1 << LONGEST, np.uint32)
        self.bits = np.ones(1 << LONGEST, np.int64)
        self.symbol[: fill.sum()] = np.repeat(order, fill)
        self.bits[: fill.sum()] = np.repeat(self.lengths[order], fill)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits and the bit offset of every ``EVERY``-th id."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        place = at >> 3
        value = self.codes[ids].astype(np.int64) << (24 - size - (at & 7))
        n = (int(end[-1]) + 7 >> 3 if len(ids) else 0) + 2
        # The bits of different ids never overlap, so sums are unions.
        out = np.zeros(n + 2, np.int64)
        for k in range(3):
            part = np.bincount(place, value >> (16 - 8 * k) & 255, n).astype(np.int64)
            out[k : k + len(part)] += part
        return out[:n].astype(np.uint8).tobytes(), at[::EVERY]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> np.ndarray:
        """The ids of several blocks, one after the other; all stretches between checkpoints advance side by side."""
        base = np.cumsum([0, *(len(p) for p in payloads)])
        raw = np.frombuffer(b"".join(payloads) + b"\0\0\0", np.uint8).astype(np.uint32)
        window = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        bit = np.concatenate([np.zeros(0, np.int64), *(c + 8 * b for c, b in zip(checkpoints, base, strict=False))])
        size = np.concatenate([np.zeros(0, np.int64), *(np.minimum(EVERY, n - EVERY * np.arange(-(-n // EVERY))) for n in counts)])
        out = np.zeros((EVERY, len(bit)), np.uint32)
        for k in range(EVERY if len(bit) else 0):
            at = np.minimum(bit >> 3, len(window) - 1)
            look = window[at] >> (8 - (bit & 7)).astype(np.uint32) & np.uint32(0xFFFF)
            out[k] = self.symbol[look]
            bit = bit + self.bits[look]
        return out.T[np.arange(EVERY) < size[:, None]]
