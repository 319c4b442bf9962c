"""Exact removal of word passages that an earlier document has, by FM-indexes over shards.

A window is ``WINDOW`` consecutive words. Each window has an anchor, the least hash among its
runs of ``GRAM`` words, so equal windows have equal anchors. Consecutive windows with one anchor make a segment.

1. Anchors seen in one document only end here: none of their windows repeats. What is kept
   is a few numbers per segment, no text.
2. Equal segments are merged, with the least document that has them. Their words are read once, from that document.
3. Segments are dealt to shards by anchor. An anchor with more than ``HEAVY`` different segments (a common line in many
   surroundings) is split first: each window of it becomes a segment of its own, under its own hash, equal ones merged.
4. In each shard the first segment of every anchor goes into a compressed FM-index, and segments of later documents are streamed through it by backward search. Where their
   matching statistic reaches a window's length, the window has an earlier document. What no index holds goes on to a next index over the first of what is left.
5. Documents get back the windows with an earlier document and drop the words these cover.

Defined cases: NULL text has no words; a document shorter than a window loses nothing; rows with the same id are not earlier than one another, repeated rows
are treated alike; a row without id loses nothing and removes nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACES, arrow_map, give_back, row_key, slices, utf8
from .fm_index import FMIndex

WINDOW = 50
GRAM = 16
#: Windows of one segment at most; longer runs (a word repeated) are cut.
RUN = 256
HEAVY = 256
#: Words of one FM-index, about.
SHARD_WORDS = 300_000
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for many ranges, from sums of powers."""
    up, down = _powers(1 << int(len(values)).bit_length())
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    inner = (sums[ends] - sums[starts]) * down[starts]
    return _mix(inner + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each row the number of its first word."""
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = _IN_WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = word[:-1] & ~word[1:]
    edge = bounds[1:-1]
    inner = edge[(edge > 0) & (edge < len(data))]
    begins[inner] |= word[inner]
    stops[inner] |= word[inner - 1]
    starts = np.flatnonzero(begins[:-1])
    return starts, np.flatnonzero(stops), np.searchsorted(starts, bounds)


def segments_of(column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Row, anchor, content hash, first window and number of windows of every segment."""
    data, bounds = utf8(column)
    starts, ends, first = word_bounds(data, bounds)
    words = _range_hash(data, starts, ends)
    n = len(words) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return dict.fromkeys(("row", "anchor", "seg", "start", "n"), empty)
    run, width = words, 1
    while width < gram:
        step = min(width, gram - width)
        run = _mix(run[: len(run) - step] * np.uint64(_BASE) + run[step:] + np.uint64(width))
        width += step
    low, width, wide = run, 1, window - gram + 1
    while width < wide:
        step = min(width, wide - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)[:n]
    valid = np.arange(n) + window <= first[1:][row]
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return dict.fromkeys(("row", "anchor", "seg", "start", "n"), empty)
    long = np.add.reduceat(valid.astype(np.int64), begin)
    pieces = -(-long // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, long = np.repeat(begin, pieces) + nth * RUN, np.repeat(long, pieces) - nth * RUN
    long = np.minimum(long, RUN)
    return {
        "row": row[begin], "anchor": low[begin].view(np.int64),
        "seg": _range_hash(words, begin, begin + long + window - 1).view(np.int64),
        "start": begin - first[row[begin]], "n": long,
    }


def _find(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = segments_of(part.column("text"), window, gram)
            rows = pa.array(found["row"])
            made = [part.column("id").take(rows), part.column("row").take(rows), pa.array(found["anchor"]), pa.array(found["seg"]),
                    pa.array(found["start"].astype(np.int32)), pa.array(found["n"].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, ["id", "row", "anchor", "seg", "start", "n"])

    return arrow_map(docs, run, "id long, row long, anchor long, seg long, start int, n int")


def _texts(docs: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """The words of each distinct segment, from the document that represents it."""
    wanted = distinct.select("rep.id", "rep.row", F.struct("anchor", "seg", "rep.start", "rep.n", "least", "last").alias("s"))
    wanted = wanted.groupBy("id", "row").agg(F.collect_list("s").alias("wanted"))
    joined = docs.join(wanted, ["id", "row"]).dropDuplicates(["id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                words = text.encode().split()
                for s in wanted:
                    body = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1]).decode()
                    made.append((s["anchor"], s["seg"], s["n"], s["least"], s["last"], body))
            names = ["anchor", "seg", "n", "least", "last", "words"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*made, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return arrow_map(joined, run, "anchor long, seg long, n int, least long, last long, words string")


def _single_windows(heavy: DataFrame, window: int) -> DataFrame:
    """Every window of the segments, with a hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "words", 200_000):
            data, bounds = utf8(part.column("words"))
            starts, ends, first = word_bounds(data, bounds)
            n = np.diff(first) - window + 1
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = first[row] + at
            values = _range_hash(_range_hash(data, starts, ends), begin, begin + window).view(np.int64)
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[begin].tolist(), ends[begin + window - 1].tolist(), strict=True)]
            rows = pa.array(row)
            names = ["anchor", "seg", "least", "last"]
            arrays = [part.column(c).take(rows) for c in names]
            arrays += [pa.array(at.astype(np.int32)), pa.array(values), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "at", "value", "words"])

    return arrow_map(heavy, run, "anchor long, seg long, least long, last long, at int, value long, words string")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many ranges, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def least_weights(words: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, weights: np.ndarray, later: np.ndarray, window: int) -> np.ndarray:
    """For each word of the segments the least weight among the segments that hold the window from there on, or the segment's own.

    The first segment of every anchor is indexed, and what stands for later documents (``later``, and all other segments) is streamed through the index. Windows that are not found are
    first occurrences or stand in a later segment: runs of them are segments of a next round, whose index takes sixteen times as many of each anchor.
    """
    low = np.repeat(weights, sizes)
    # Pieces: where they start, their words and the segment they are from.
    start, long, owner, take, fresh = np.cumsum(sizes) - sizes, sizes, np.arange(len(sizes)), 1, later
    while True:
        order = np.lexsort((start, weights[owner], anchors[owner]))
        start, long, owner, fresh = start[order], long[order], owner[order], fresh[order]
        anchor = anchors[owner]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        of_anchor = np.diff(np.append(first, len(anchor)))
        rank = np.arange(len(anchor)) - np.repeat(first, of_anchor)
        alone = np.repeat(of_anchor, of_anchor) == 1
        inside = (rank < take) & (~alone | fresh)
        # Of several in the index each may hold a window that an earlier one begins.
        streamed = ~inside & ~alone | inside & (fresh | (take > 1))
        if not streamed.any():
            return low
        # Segments of one anchor only can hold a window, so where there is one of each, its weight is the anchor's.
        index = FMIndex(words[_spread(start[inside], long[inside])], long[inside], window, owners=take > 1)
        at = _spread(start[streamed], long[streamed])
        length, lo, hi = index.statistics(words[at], long[streamed])
        hit = np.flatnonzero(length >= window)
        if take == 1:
            # A streamed piece's anchor has its first piece at the group's first place.
            least = weights[owner[np.repeat(first, of_anchor)]][streamed]
            low[at[hit]] = np.repeat(least, long[streamed])[hit]
        else:
            # Pieces of an anchor are in the order of their weights.
            low[at[hit]] = weights[owner[inside]][index.least_owner(lo[hit], hi[hit])]
        open_ = np.ones(len(at), bool)
        open_[hit] = False
        piece = np.repeat(np.arange(int(streamed.sum())), long[streamed])
        ends = np.cumsum(long[streamed])
        # Only windows that lie in the piece, and only pieces that were not indexed, go on.
        open_ &= (np.arange(len(at)) + window <= ends[piece]) & ~inside[streamed][piece]
        begins = open_.copy()
        begins[1:] &= ~open_[:-1] | (piece[1:] != piece[:-1])
        run = np.flatnonzero(begins)
        if not len(run):
            return low
        n = np.add.reduceat(open_.astype(np.int64), run)
        start, long, owner = at[run], n + window - 1, owner[streamed][piece[run]]
        take, fresh = 16 * take, np.zeros(len(run), bool)


def _indexed(segments: DataFrame, shards: int, window: int) -> DataFrame:
    """``lows``: for each segment the windows and the least document that has each."""

    def run(part: pa.Table) -> pa.Table:
        lists = [w.encode().split() for w in part.column("words").to_pylist()]
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for ws in lists for w in ws), np.int64)
        sizes = np.array([len(ws) for ws in lists], np.int64)
        del lists, numbers
        least, last, anchors = (part.column(c).to_numpy() for c in ("least", "last", "anchor"))
        low = least_weights(words, sizes, anchors, least, last > least, window)
        n = sizes - window + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        values = low[np.repeat(np.cumsum(sizes) - sizes, n) + at]
        pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(values)], ["at", "low"])
        lows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pairs)
        made = pa.table({"single": part.column("single"), "anchor": part.column("anchor"), "seg": part.column("seg"), "lows": lows})
        give_back()
        return made

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "single boolean, anchor long, seg long, lows array<struct<at:int,low:long>>")


def covered_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``id``, ``row`` and ``starts``: windows of the document that start in an earlier one too.

    ``docs`` has ``id``, ``row`` (equal for repeated rows) and ``text``.
    """
    found = stage(_find(docs, window, gram), "segments")
    shared = found.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    kept = stage(found.join(shared, "anchor", "left_semi"), "shared")
    distinct = kept.groupBy("anchor", "seg").agg(F.min(F.struct("id", "row", "start", "n")).alias("rep"), F.max("id").alias("last"))
    texts = stage(_texts(docs, distinct.withColumn("least", F.col("rep.id")), window), "words")
    often = stage(texts.groupBy("anchor").count().where(F.col("count") > heavy).select("anchor"), "heavy")
    columns = [F.lit(False).alias("single"), "anchor", "seg", "least", "last", "words"]
    light = texts.join(often, "anchor", "left_anti").select(*columns)
    made = _single_windows(texts.join(often, "anchor", "left_semi"), window)
    # Two hashes of different kinds, 128 bits, stand for a window's words.
    single = stage(made.withColumn("check", F.xxhash64("words")), "single")
    merged = single.groupBy("value", "check").agg(F.min("least").alias("least"), F.max("last").alias("last"), F.min("words").alias("words"))
    merged = merged.where("least < last").select(F.lit(True).alias("single"), F.col("value").alias("anchor"), F.col("check").alias("seg"), "least", "last", "words")
    segments = stage(light.unionByName(merged), "indexed")
    words = segments.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(int(words / 6 / shard_words), 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lows = stage(_indexed(segments, shards, window), "lows")
    of_single = (
        single.select("anchor", "seg", "at", "value", "check")
        .join(lows.where("single").select(F.col("anchor").alias("value"), F.col("seg").alias("check"), F.col("lows")[0]["low"].alias("low")), ["value", "check"])
        .groupBy("anchor", "seg").agg(F.collect_list(F.struct("at", "low")).alias("lows"))
    )
    every = lows.where("not single").select("anchor", "seg", "lows").unionByName(of_single)
    early = F.filter("lows", lambda w: w["low"] < F.col("id"))
    starts = F.transform(early, lambda w: w["at"] + F.col("start"))
    hits = kept.join(every, ["anchor", "seg"]).select("id", "row", "start", starts.alias("starts")).where(F.size("starts") > 0)
    once = hits.groupBy("id", "row", "start").agg(F.first("starts").alias("starts"))
    return once.groupBy("id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def drop_words(text: str | None, starts: list[int] | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words kept and the number removed."""
    words = (text or "").encode().split()
    if not starts:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(starts))
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], int((~keep).sum())


def deduplicate(df: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW, carry: bool = False, **sizes: int) -> DataFrame:
    """``id_``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row.

    With ``carry`` also ``kept``, the text that is left, and the input row as struct ``row``.
    """
    kind = df.schema[id_].dataType.simpleString()
    plain = df.select(F.col(id_).alias("id"), row_key(id_, text).alias("row"), F.col(text).alias("text"))
    starts = stage(covered_windows(plain.where("id is not null and text is not null"), window, **sizes), "starts")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if carry else F.lit(True)
    row = df.schema.simpleString() if carry else "boolean"
    full = df.select(F.col(id_).alias("id"), row_key(id_, text).alias("row"), F.col(text).alias("text"), whole.alias("carried"))
    joined = full.join(starts, ["id", "row"], "left").select("id", "text", "carried", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n_words, removed, digests, kept = [], [], [], []
            for t, s in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True):
                words, gone = drop_words(t, s, window)
                body = b" ".join(words)
                n_words.append(len(words) + gone)
                removed.append(gone)
                digests.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode() if carry else None)
            arrays = [part.column("id"), part.column("carried"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "row", "n_words", "n_removed", "kept_sha256", "kept"])

    done = arrow_map(joined, run, f"id {kind}, row {row}, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(F.col("id").alias(id_), *["row", "kept"][: 2 * int(carry)], "n_words", "n_removed", "kept_sha256")
