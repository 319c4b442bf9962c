"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, letters in lower case. Every window of
consecutive item words is a pattern, with a space at either end so that it matches whole words
only. A text is scanned once; a match is mapped to its words and those to places in the original.

The patterns of an automaton are bounded by ``PATTERNS``. A larger benchmark is cut into blocks with a
pass each, whose results are united row by row.

Defined cases: NULL or empty text has no words and is clean; a NULL or empty item has no windows; an item shorter than a
window is one window; repeated items all count, by their ids, an item without an id marks words but
is not listed; repeated documents are repeated. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, slices

WINDOW = 10
#: Patterns of one automaton: with windows of ten words some 100 MB in each Python worker.
PATTERNS = 40_000
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(text: str | None, width: int = WINDOW) -> set[str]:
    """The patterns of an item, as Latin-1 text so that one character is one byte."""
    words = words_of(text)
    if not words:
        return set()
    last = max(0, len(words) - width)
    return {b" ".join([b"", *words[i : i + width], b""]).decode("latin-1") for i in range(last + 1)}


def automaton(patterns: dict[str, list]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        found.add_word(pattern, (pattern.count(" ") - 1, items))
    found.make_automaton()
    return found


def matches(text: str | None, search: ahocorasick.Automaton) -> tuple[int, np.ndarray, set]:
    """Number of words, which of them are hit, and the items found."""
    words = words_of(text)
    items: set = set()
    hit = np.zeros(len(words) + 1, np.int64)
    if words and len(search):
        line = b" ".join([b"", *words, b""]).decode("latin-1")
        spaces = None
        for end, (width, ids) in search.iter(line):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            stop = int(np.searchsorted(spaces, end))
            hit[stop - width] += 1
            hit[stop] -= 1
            items.update(ids)
    return len(words), np.cumsum(hit[:-1]) > 0, items


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point bounds in the original text."""
    folded = text.encode().translate(_FOLD)
    bounds = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
    return [
        {"start": int(points[bounds[a][0]]), "end": int(points[bounds[b - 1][1]])}
        for a, b in zip(edge[::2], edge[1::2], strict=True)
    ]


def _blocks(benchmark: DataFrame, item: str, text: str, width: int) -> Iterator[dict[str, list]]:
    """Patterns with the items that have them, block by block, never more than one block at a time."""
    block: dict[str, list] = {}
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        for pattern in windows_of(row.t, width):
            block.setdefault(pattern, []).extend([] if row.i is None else [row.i])
        if len(block) >= PATTERNS:
            yield block
            block = {}
    yield block


def scan(
    df: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", width: int = WINDOW, carry: bool = False,
) -> DataFrame:
    """``id_``, ``n_words``, ``n_hit``, ``items`` (sorted ids as text) and ``spans`` of every row.

    With ``carry``, the input row comes along as the struct ``row``.
    """
    spark = df.sparkSession
    kind = df.schema[id_].dataType.simpleString()
    row = df.schema.simpleString() if carry else "boolean"
    start = f"id {kind}, text string, row {row}"
    more = "hit binary, items array<string>"
    end = f"id {kind}, row {row}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if carry else F.lit(True)
    state = df.select(
        F.col(id_).alias("id"), F.col(text).alias("text"), whole.alias("row"),
        F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"),
    )

    def one(block, last):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = automaton(block.value)
            for part in slices(batches, "text"):
                counts, hits, items, spans = [], [], [], []
                columns = [part.column(c).to_pylist() for c in ("text", "hit", "items")]
                for t, old, known in zip(*columns, strict=True):
                    n, hit, found = matches(t, search)
                    if old:
                        hit = hit | np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                    counts.append(n)
                    hits.append(hit)
                    items.append(sorted({*known, *found}))
                    spans.append(original_spans(t, hit) if last and hit.any() else [])
                items = pa.array(items, pa.list_(pa.string()))
                if last:
                    made = {
                        "n_words": pa.array(counts, pa.int64()),
                        "n_hit": pa.array([int(h.sum()) for h in hits], pa.int64()),
                        "items": items,
                        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    }
                    kept = {c: part.column(c) for c in ("id", "row")}
                else:
                    packed = [np.packbits(h).tobytes() if h.any() else None for h in hits]
                    made = {"hit": pa.array(packed, pa.binary()), "items": items}
                    kept = {c: part.column(c) for c in ("id", "text", "row")}
                yield pa.RecordBatch.from_pydict(kept | made)

        return run

    blocks = _blocks(benchmark, item, item_text, width)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shape = end if after is None else f"{start}, {more}"
        state = arrow_map(state, one(spark.sparkContext.broadcast(block), after is None), shape)
        if after is not None:
            state = stage(state, "scanned")
        block = after
    return state.select(F.col("id").alias(id_), *["row"][: int(carry)], "n_words", "n_hit", "items", "spans")
