"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's new words (white space and what follows it) are put in one text. Its suffixes are sorted by their first characters, as many as the longest
piece has; every piece is looked up by binary search, and its range of suffixes gives the places where it
occurs. These are edges from place to place. Sorted by where they end, they are relaxed: a
place is reached by the one edge whose piece may follow the piece that its start was reached by.

For pieces merged by score this is exact. A piece may follow another if merging the characters of both alone never crosses the border. Merging a whole
text takes the best pair anywhere, hence also the best of those two pieces, so it leaves the borders of a split just if all
neighbours may follow one another. Two characters that stand together in no piece are always a border.

Characters without a piece become one piece per byte. A worker keeps the words it has met, up to a bound.

Defined cases: NULL counts as empty and has no ids; repeated rows are repeated; decoding gives the text back, but a
literal U+2581 comes back as a space, as in the library. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_transducer import _Table
from .common import arrow_map, slices

#: Words a worker keeps.
WORDS = 400_000
#: Characters indexed at once; each takes some 200 bytes for a moment.
STEP = 300_000
#: Tested pairs of pieces a worker keeps.
PAIRS = 2_000_000
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """The pieces of a model file, and the words encoded so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(len(names))]
        self.pieces = names
        self.number = {p: i for i, p in enumerate(names) if plain[i]}
        self.score = {p: model.get_score(i) for p, i in self.number.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.none = len(names)
        self.unknown = len(names) + 1
        signs = sorted({c for p in self.number for c in p})
        self.sign = {c: k + 2 for k, c in enumerate(signs)}
        self.sign_of = np.ones(0x110000, np.uint16)
        self.sign_of[[ord(c) for c in signs]] = np.arange(2, len(signs) + 2)
        self.single = np.full(len(signs) + 2, self.unknown, np.int64)
        for c, k in self.sign.items():
            self.single[k] = self.number.get(c, self.unknown)
        self.together = np.zeros((len(signs) + 2, len(signs) + 2), bool)
        for p in self.number:
            for a, b in zip(p, p[1:], strict=False):
                self.together[self.sign[a], self.sign[b]] = True
        several = [(p, i) for p, i in self.number.items() if len(p) > 1]
        self.longest = max((len(p) for p, _ in several), default=1)
        self.found_ids = np.array([i for _, i in several], np.int64)
        self.length = np.ones(len(names) + 2, np.int64)
        self.length[self.found_ids] = [len(p) for p, _ in several]
        low = np.zeros((len(several), self.longest), ">u2")
        for k, (p, _) in enumerate(several):
            low[k, : len(p)] = [self.sign[c] for c in p]
        high = np.where(np.arange(self.longest) < self.length[self.found_ids][:, None], low, 0xFFFF).astype(">u2")
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{2 * self.longest}").ravel() for x in (low, high))
        self.text = [n.replace(SPACE, " ").encode() for n in names]
        for i in range(len(names)):
            if model.is_control(i):
                self.text[i] = b""
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.pairs = _Table()
        self.fresh()

    def fresh(self) -> None:
        self.word: dict[str, int] = {}
        self.ids, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _stays(self, first: str, second: str) -> bool:
        """Whether merging the characters of both by score ends with just these two pieces (``first`` may be empty)."""
        parts, border, score = list(first + second), len(first), self.score
        edge = border
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return len(parts) == (2 if border else 1)
            if border and at == edge - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at < edge:
                edge -= 1

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = before * (self.none + 2) + piece
        value = self.pairs.find(key)
        new = np.unique(key[value < 0])
        if len(new):
            if self.pairs.used > PAIRS:
                self.pairs = _Table()
                new = np.unique(key)
            name = lambda i: "" if i >= self.none else self.pieces[i]
            made = [self._stays(name(k // (self.none + 2)), name(k % (self.none + 2))) for k in new.tolist()]
            self.pairs.add(new, np.array(made, np.int64))
            value = self.pairs.find(key)
        return value == 1

    def split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, one after the other, and the number for each; unknown characters are ``unknown``."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        signs = self.sign_of[points]
        n = len(signs)
        edge = np.ones(n, bool)
        edge[1:] = ~self.together[signs[:-1], signs[1:]]
        edge[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], n)
        run = np.cumsum(edge) - 1
        # A zero ends each run in the text that is indexed; ``at`` is where a character stands there.
        at = np.arange(n) + run
        text = np.zeros(n + len(begin) + self.longest, ">u2")
        text[at] = signs
        several = stop - begin > 1
        places = at[np.repeat(several, stop - begin)]
        window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, self.longest)[places])
        # What follows the end of a run is of no matter.
        window[np.logical_or.accumulate(window == 0, axis=1)] = 0
        suffixes = window.view(f"S{2 * self.longest}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        first, last = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        count = last - first
        hit = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        char = np.flatnonzero(np.repeat(several, stop - begin))
        start = np.concatenate([char[order[hit]], char])
        piece = np.concatenate([np.repeat(self.found_ids, count), self.single[signs[char]]])
        # Reached places: before character k of run r is k + r, its end one further.
        source = start + run[start]
        target = source + self.length[piece]
        depth = target - (begin + np.arange(len(begin)))[run[start]]
        turn = np.argsort(depth, kind="stable")
        source, target, piece, depth = source[turn], target[turn], piece[turn], depth[turn]
        by = np.full(n + len(begin), -1, np.int64)
        by[begin + np.arange(len(begin))] = self.none
        bounds = np.searchsorted(depth, np.arange(1, depth[-1] + 2 if len(depth) else 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            good = self.may_follow(by[source[a:b]], piece[a:b])
            by[target[a:b][good]] = piece[a:b][good]
        # Back from the ends of all runs at once.
        place, home = stop + np.arange(len(begin)), begin + np.arange(len(begin))
        by[place[~several]] = self.single[signs[begin[~several]]]
        marks, live = [], np.arange(len(begin))
        while len(live):
            marks.append(place[live])
            place[live] -= self.length[by[place[live]]]
            live = live[place[live] > home[live]]
        marks = np.sort(np.concatenate([np.zeros(0, np.int64), *marks]))
        # A place belongs to the run whose start is the last before it.
        owner = np.searchsorted(home, marks, "left") - 1
        word_of_run = np.repeat(np.arange(len(words)), sizes)[begin]
        return by[marks], np.bincount(word_of_run[owner], minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        pieces, counts = self.split(words)
        strange = np.flatnonzero(pieces == self.unknown)
        if len(strange):
            begin = np.cumsum(self.length[pieces]) - self.length[pieces]
            text = "".join(words)
            spelled = [text[c].encode() for c in begin[strange].tolist()]
            times = np.ones(len(pieces), np.int64)
            times[strange] = [len(b) for b in spelled]
            owner = np.repeat(np.arange(len(words)), counts)
            counts = np.bincount(owner, times, len(words)).astype(np.int64)
            pieces = np.repeat(pieces, times)
            pieces[pieces == self.unknown] = [self.byte[b] for b in b"".join(spelled)]
        first = len(self.word)
        while len(self.ids) < self.used + len(pieces):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.size) < first + len(words):
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        self.ids[self.used : self.used + len(pieces)] = pieces
        self.size[first : first + len(words)] = counts
        self.start[first : first + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(pieces)
        self.word.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of ids of each."""
        if len(self.word) > WORDS:
            self.fresh()
        lists = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*lists) - self.word.keys())
        ends = np.cumsum([len(w) for w in new])
        at = 0
        while at < len(new):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + STEP, side="right")))
            self._learn(new[at:stop])
            at = stop
        words = np.fromiter(map(self.word.__getitem__, chain.from_iterable(lists)), np.int64)
        size = self.size[words]
        end = np.cumsum(size)
        at = np.arange(size.sum()) + np.repeat(self.start[words] - (end - size), size)
        per_word = np.concatenate([[0], end])
        return self.ids[at], np.diff(per_word[np.cumsum([0, *(len(ws) for ws in lists)])])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of each text in the array ``into``, in place of ``text``. ``path`` is the model's file on every machine.

    ``decoded`` names a column for the text that the ids decode to, made in the same pass.
    """
    kept = [c for c in df.columns if c not in (text, into, decoded)]
    row = df.select(*[F.col(f"`{c}`") for c in kept]).schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in slices(batches, "text"):
            ids, counts = model.encode(part.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            arrays, names = [part.column("row"), lists], ["row", "ids"]
            if decoded:
                bounds = offsets.tolist()
                back = [model.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
                arrays, names = [*arrays, pa.array(back, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    plain = df.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    made = arrow_map(plain, run, f"row {row}, ids array<int>" + ", text string" * bool(decoded))
    more = [F.col("text").alias(decoded)] if decoded else []
    return made.select(*[F.col(f"row.`{c}`") for c in kept], F.col("ids").alias(into), *more)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the text of the array ``ids`` in ``into``; NULL ids give empty text."""
    kept = [c for c in df.columns if c not in (ids, into)]
    row = df.select(*[F.col(f"`{c}`") for c in kept]).schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [model.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(texts, pa.string())], ["row", "ids", "text"])

    plain = df.select(F.col(ids).alias("ids"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    made = arrow_map(plain, run, f"row {row}, ids array<int>, text string")
    return made.select(*[F.col(f"row.`{c}`") for c in kept], F.col("ids").alias(ids), F.col("text").alias(into))
