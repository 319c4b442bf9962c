"""A word tokenizer compiled to two deterministic finite-state transducers.

The first cuts normalised text into words. It has few states, so the effect of a chunk of text is a map from
states to states; these maps compose, and a parallel prefix scan over the chunks gives the state that each
chunk is entered with.

The second reads one word and annotates each transition with the change of the number of tokens. Its states are determined when first met, as the
set of all is far larger than what any corpus reaches: a state is the longest end of the word so far that some
vocabulary entry may still begin with, the last token of every prefix that ends inside it, and
their token counts relative to the whole. Merging is settled pair by pair: two tokens may be neighbours if no merge
across their border comes before the merges that complete them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

CHUNK = 256
#: States kept before the second transducer starts afresh; some 200 MB.
STATES = 300_000

# Symbols of the first transducer; the last two are apostrophes that begin a contraction of two or three characters.
SPACE, LETTER, NUMBER, OTHER, TWO, THREE = range(6)
# Its states: between words, in letters, in other signs, two or one characters of a contraction to come, after a closed word.
_OUT, _LETTERS, _OTHERS, _NEED2, _NEED1, _CLOSED = range(6)


def _first_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word begins, by state and symbol."""
    to, begins = np.zeros((6, 6), np.uint8), np.zeros((6, 6), bool)
    for state in range(6):
        for symbol in range(6):
            if state in (_NEED2, _NEED1):
                to[state, symbol] = _NEED1 if state == _NEED2 else _CLOSED
                continue
            sign = symbol in (OTHER, TWO, THREE)
            goes_on = (state == _LETTERS and symbol == LETTER) or (state == _OTHERS and sign)
            begins[state, symbol] = symbol != SPACE and not goes_on
            if goes_on:
                to[state, symbol] = state
            else:
                to[state, symbol] = {SPACE: _OUT, LETTER: _LETTERS, NUMBER: _CLOSED, OTHER: _OTHERS, TWO: _NEED1, THREE: _NEED2}[symbol]
    return to, begins


_TO, _BEGINS = _first_machine()


@lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and symbol class of every code point, both as the tokenizer library knows them: its Unicode version is not Python's."""
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    kind = np.full(0x110000, OTHER, np.uint8)
    for symbol, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        for _, (begin, end) in runs:
            kind[points[begin:end]] = symbol
    low = np.arange(0x110000, dtype=np.uint32)
    # Marked off one by one, as a lower case may have two code points; the mark's own line would be split.
    mark = points != 10
    small = normalizers.Lowercase().normalize_str("\n".join(every.replace("\n", ""))).split("\n")
    single = np.array([len(x) == 1 for x in small])
    low[points[mark][single]] = np.frombuffer("".join(x for x in small if len(x) == 1).encode("utf-32-le"), np.uint32)
    return low, kind


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Where words begin, from the symbols of the whole text."""
    n = len(kinds)
    chunks = max(1, -(-n // CHUNK))
    grid = np.full(chunks * CHUNK, SPACE, np.uint8)
    grid[:n] = kinds
    steps = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    table = _TO.ravel()
    # Every chunk from every state at once.
    maps = np.tile(np.arange(6, dtype=np.uint8), (chunks, 1))
    for symbols in steps:
        maps = table[maps * np.uint8(6) + symbols[:, None]]
    # Inclusive scan: after the step with a given reach, a map covers twice as many chunks.
    reach = 1
    while reach < chunks:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), 1)
        reach *= 2
    state = np.concatenate([[_OUT], maps[:-1, _OUT]]).astype(np.uint8)
    starts = np.empty((CHUNK, chunks), bool)
    flags = _BEGINS.ravel()
    for k, symbols in enumerate(steps):
        cell = state * np.uint8(6) + symbols
        starts[k] = flags[cell]
        state = table[cell]
    return starts.T.ravel()[:n]


class _Table:
    """Numbers by number, in arrays, so that many keys are looked up at once."""

    def __init__(self):
        self.keys, self.values, self.used = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        slot = self._slots(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be new and distinct."""
        while 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            k, v = self.keys[old], self.values[old]
            self.keys, self.values, self.used = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int64), 0
            self.add(k, v)
        self.used += len(keys)
        slot = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            claim = left[free]
            self.keys[slot[claim]] = keys[claim]  # of several claims to a slot one remains
            won = claim[self.keys[slot[claim]] == keys[claim]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Transducer:
    """Token counts of words under byte-pair merges with a mark at the word's end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.signs = byte_signs()
        self.vocabulary = set(model["vocab"])
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.find_special = re.compile("|".join(map(re.escape, self.special)))
        self.rank: dict[tuple[str, str], int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[a, b] = k
            self.split.setdefault(a + b, (a, b))
        self.prefixes = {t[:k] for t in self.vocabulary for k in range(1, len(t) + 1) if not t[:k].endswith(">") or k < len(t)}
        self.fresh()

    def fresh(self) -> None:
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.table = _Table()
        self._spines: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self.start = self._number(("", (None,), (0,)))

    def _number(self, state: tuple) -> int:
        if state not in self.states:
            self.states[state] = len(self.known)
            self.known.append(state)
        return self.states[state]

    def _spine(self, token: str, right: bool) -> list[tuple[str, float]]:
        """Parts at one edge of a token, from its outermost sign to itself, each with the rank of the merge that ends it."""
        found = self._spines.get((token, right))
        if found is None:
            found, part, rank = [], token, float("inf")
            while True:
                found.append((part, rank))
                if part not in self.split:
                    break
                pair = self.split[part]
                part, rank = pair[right], self.rank[pair]
            found = self._spines[token, right] = found[::-1]
        return found

    def may_follow(self, first: str, second: str) -> bool:
        answer = self._pairs.get((first, second))
        if answer is None:
            left, right, i, j = self._spine(first, True), self._spine(second, False), 0, 0
            answer = True
            while True:
                (a, a_ends), (b, b_ends) = left[i], right[j]
                across = self.rank.get((a, b), float("inf"))
                # Of equal ranks the leftmost merge comes first.
                if across < a_ends and across <= b_ends and across != float("inf"):
                    answer = False
                    break
                if a_ends == b_ends == float("inf"):
                    break
                if a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
            self._pairs[first, second] = answer
        return answer

    def _read(self, state: tuple, sign: str) -> tuple[tuple, int]:
        """The state after one more sign and the change of the number of tokens."""
        suffix, last, counts = state
        for k in range(len(suffix), -1, -1):
            token = suffix[len(suffix) - k :] + sign
            if token in self.vocabulary:
                before = last[len(last) - 1 - k]
                if before is None or self.may_follow(before, token):
                    break
        else:
            raise ValueError(f"no token ends with {sign!r}")
        change = counts[len(counts) - 1 - k] + 1
        if sign.endswith(self.end) and len(sign) > 1:
            return ("", (None,), (0,)), change
        longer = suffix + sign
        at = next((i for i in range(len(longer)) if longer[i:] in self.prefixes), len(longer))
        keep = len(longer) - at + 1
        return (longer[at:], (*last, token)[-keep:], tuple(c - change for c in (*counts, change))[-keep:]), change

    def _determine(self, key: int) -> int:
        state, final, point = self.known[key >> 22], key >> 21 & 1, key & 0x1FFFFF
        signs = [self.signs[b] for b in chr(point).encode()]
        if final:
            signs[-1] += self.end
        change = 0
        for sign in signs:
            state, more = self._read(state, sign)
            change += more
        return self._number(state) << 16 | change + 0x8000

    def count_words(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word, all words side by side, one character a step."""
        if len(self.known) > STATES:
            self.fresh()
        order = np.argsort(-sizes, kind="stable")
        start, size = starts[order], sizes[order]
        state = np.full(len(order), self.start, np.int64)
        total = np.zeros(len(order), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            state = state[:live]
            final = (size[:live] == step + 1).astype(np.int64)
            key = state << 22 | final << 21 | points[start[:live] + step].astype(np.int64)
            value = self.table.find(key)
            new = np.unique(key[value < 0])
            if len(new):
                made = np.array([self._determine(k) for k in new.tolist()], np.int64)
                self.table.add(new, made)
                value = self.table.find(key)
            state = value >> 16
            total[:live] += (value & 0xFFFF) - 0x8000
        out = np.empty_like(total)
        out[order] = total
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text, as the library gives them without added special tokens."""
        low, kind = character_tables()
        special = np.zeros(len(texts), np.int64)
        ready = []
        for r, text in enumerate(texts):
            text = text or ""
            if any(s in text for s in self.special):
                text, special[r] = self.find_special.subn(" ", text)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("İ", "i̇")
            ready.append(text)
        raw = np.frombuffer(" ".join(ready).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in ready)])
        points, kinds = low[raw], kind[raw]
        quote = np.flatnonzero(points == 39)
        if len(quote):
            padded = np.concatenate([points, np.zeros(2, np.uint32)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            kinds[quote[short]] = TWO
            kinds[quote[long]] = THREE
        begins = word_starts(kinds)
        edges = np.flatnonzero(begins | (kinds == SPACE))
        ends = np.append(edges[1:], len(points))
        word = begins[edges]
        starts = edges[word]
        counts = self.count_words(points, starts, ends[word] - starts)
        sums = np.concatenate([[0], np.cumsum(counts)])
        return special + np.diff(sums[np.searchsorted(starts, bounds)])
