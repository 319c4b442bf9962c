"""Token ids of a corpus in files: canonical Huffman codes from global counts, in blocks that decode independently.

A folder holds two Parquet tables. ``codebook`` has the code length of each id, one row. ``blocks`` has one file for each range of
document ids, in ascending order, and a row for each block of whole documents: ``part`` and ``ids_before``, the
place of its first id; the ids of its documents and how many tokens each has; the coded bits; the bit
offset of every 256th token, from which decoding can begin.

The tokenizers library encodes each distinct piece of a word once per worker, as white space always parts tokens in its vocabulary; pieces are kept
for later batches, up to a bound. The pieces of a batch are cut and told apart in arrays, and only its distinct ones looked up.

Defined cases: NULL counts as empty and holds the end id only; repeated rows are written repeatedly; equal ids are
in the order of their first 32 tokens, then of a hash; rows without id come first; an empty table gives files without rows. A vocabulary beyond 16 bits is an error. Extra columns are ignored.
A very long text is one row, its words are looked up in steps of two million bytes; a task needs about 25 times its bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, stage
from .common import SLICE_BYTES, SPACES, arrow_map, collector_off, slices, utf8
from .huffman import Codec, code_lengths
from .substrings import _range_hash, word_bounds

END = 2
#: Ids of a block at least, but for the last of a part.
BLOCK = 1 << 16
#: Distinct words a worker keeps, some 150 MB.
WORDS = 800_000
#: Documents of one decoding step hold about so many bytes of bits.
STEP = 2_000_000
#: Kinds of bytes: letters, digits, other printable ASCII, and what the library alone knows how to cut: the apostrophe, which may begin a contraction, the sign that
#: special tokens begin with, and all that is not printable ASCII.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[ord("'"), ord("<")]] = _ODD
_KIND[list(SPACES)] = 0
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = _LETTER
_BLOCKS = "part int, block int, ids_before long, n_ids long, doc_ids array<long>, n_tokens array<int>, checkpoints binary, payload binary"


def pieces_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of texts whose ids do not depend on what is beside them: the bytes to look up, starts, ends, whether a piece is plain, and the first piece of each text.

    A word of plain signs is cut as the library's pre-tokenizer would, into letters, single digits and the signs between, in lower case; another word is one piece.
    """
    starts, ends, _ = word_bounds(data, bounds)
    kind = _KIND[data]
    odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
    plain = odd[ends] == odd[starts]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[plain]] = 1
    inside[ends[plain]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    begins = inside & (kind == _DIGIT)
    begins[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    begins[starts] = True
    cuts = np.flatnonzero(begins)
    word = np.searchsorted(starts, cuts, side="right") - 1
    stops = np.minimum(np.append(cuts[1:], len(data)), ends[word])
    return np.where(inside, _LOWER[data], data), cuts, stops, plain[word], np.searchsorted(cuts, bounds)


class WordEncoder:
    """Ids of texts by way of the library's ids of their words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits, which the files hold")
        self.fresh()

    def fresh(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.start, self.used = np.zeros(1 << 16, np.int64), 0

    def _ids_of(self, pieces: list[bytes], plain: list[bool]) -> list[list[int]]:
        """Ids of each piece: plain ones go to the library's model, the whole library takes the others."""
        lists: list = [None] * len(pieces)
        tokenize = self.tokenizer.model.tokenize
        other = []
        for k, (piece, easy) in enumerate(zip(pieces, plain, strict=True)):
            if easy:
                lists[k] = [t.id for t in tokenize(piece.decode())]
            else:
                other.append(k)
        texts = [pieces[k].decode() for k in other]
        for k, found in zip(other, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            lists[k] = found.ids
        return lists

    def _learn(self, words: list[bytes], plain: list[bool]) -> None:
        lists = self._ids_of(words, plain)
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, sizes.sum())
        first = len(self.number)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.size) < first + len(words):
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[first : first + len(words)] = sizes
        self.start[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The number of each piece of ``data``; only distinct ones are looked up."""
        _, where, which = np.unique(_range_hash(data, starts, ends), return_index=True, return_inverse=True)
        length, like = ends - starts, starts[where][which]
        same = (length == length[where][which]).all()
        if same:
            # Pieces of one hash are compared byte by byte.
            within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            same = (data[np.repeat(starts, length) + within] == data[np.repeat(like, length) + within]).all()
        if not same:
            where, which = np.arange(len(starts)), slice(None)
        raw, get = data.tobytes(), self.number.get
        pieces = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        known = [get(p, -1) for p in pieces]
        numbers = np.array(known, np.int64)
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            fresh = {pieces[k]: bool(plain[where[k]]) for k in new}
            self._learn(list(fresh), list(fresh.values()))
            numbers[new] = [self.number[pieces[k]] for k in new]
        return numbers[which]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the number of ids of each."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        data, starts, ends, plain, first = pieces_of(*utf8(column))
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(starts):
            # A long text is many steps.
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
            if len(self.number) > WORDS:
                self.fresh()
            low, high = starts[at], ends[stop - 1]
            words = self._numbers(data[low:high], starts[at:stop] - low, ends[at:stop] - low, plain[at:stop])
            size = self.size[words]
            spot = np.arange(size.sum()) + np.repeat(self.start[words] - (np.cumsum(size) - size), size)
            found.append(self.ids[spot])
            sizes.append(size)
            at = stop
        per_word = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        counts = np.diff(per_word[first])
        plain = np.concatenate(found)
        out = np.full(len(plain) + len(column), END, np.uint32)
        out[np.arange(len(plain)) + np.repeat(np.arange(len(column)), counts)] = plain
        return out, counts + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(df: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``ids``, unsigned 16-bit integers in one binary, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for part in slices(batches, "text"):
            with collector_off():
                ids, counts = words.encode(part.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)]) * 2
            small = pa.py_buffer(ids.astype("<u2").tobytes())
            binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), small])
            yield pa.RecordBatch.from_arrays([part.column("id"), binary.cast(pa.binary())], ["id", "ids"])

    plain = df.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    return arrow_map(plain, run, "id long, ids binary")


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus; as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for part in slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    sums = arrow_map(encoded.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        counts[row["id"]] = row["n"]
    return counts


def write_ids(df: DataFrame, folder: str, path: str, id_: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Encode the texts of ``df`` by the tokenizer file at ``path`` and write them to ``folder``."""
    spark = df.sparkSession
    encoded = stage(encode_texts(df, path, id_, text), "ids")
    lengths = code_lengths(count_ids(encoded))
    book = spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary")
    book.coalesce(1).write.parquet(f"{folder}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part = Codec(lengths), TaskContext.get().partitionId()
        docs: list = []
        held = before = number = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(d[1] for d in docs), "<u2")
            payload, checkpoints = codec.encode(ids)
            row = {
                "part": part, "block": number, "ids_before": before, "n_ids": len(ids), "doc_ids": [d[0] for d in docs],
                "n_tokens": [len(d[1]) // 2 for d in docs], "checkpoints": checkpoints.astype("<i8").tobytes(), "payload": payload,
            }
            kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                               ("n_tokens", pa.list_(pa.int32())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            for id_, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append((id_, ids))
                held += len(ids) // 2
                if held >= block:
                    yield close()
                    before, number, docs, held = before + held, number + 1, [], 0
        if docs:
            yield close()

    # Range bounds are sampled, so they hold few bytes of a row.
    by = ["id", F.substring("ids", 1, 64), F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(*by).sortWithinPartitions(*by)
    arrow_map(ordered, run, _BLOCKS).write.parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids`` (unsigned 32-bit integers in one binary) of every document."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{folder}/codebook").first()["lengths"], np.uint8)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for rows in slices(batches, "payload", STEP):
            checkpoints = [np.frombuffer(c, "<i8") for c in rows.column("checkpoints").to_pylist()]
            n_ids = rows.column("n_ids").to_pylist()
            ids = codec.decode(rows.column("payload").to_pylist(), checkpoints, n_ids)
            sizes = rows.column("n_tokens").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            docs = rows.column("n_tokens").value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            shift = np.repeat(rows.column("ids_before").to_numpy(zero_copy_only=False) - (np.cumsum(n_ids) - n_ids), docs)
            offsets = np.concatenate([first, [sizes.sum()]]) * 4
            buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]
            binary = pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary())
            part = np.repeat(rows.column("part").to_numpy(zero_copy_only=False), docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), rows.column("doc_ids").flatten(), pa.array(first + shift), pa.array(sizes), binary], ["part", "doc_id", "within", "n_tokens", "ids"]
            )

    docs = arrow_map(blocks, run, "part int, doc_id long, within long, n_tokens long, ids binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so few of them at any size.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    placed = docs.join(F.broadcast(parts), "part")
    return placed.select("doc_id", (F.col("from") + F.col("within")).alias("start"), "n_tokens", "ids")


def round_trip(df: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Write to a new folder in the shared place and read back."""
    folder = scratch_path(df.sparkSession, "token-files")
    write_ids(df, folder, path, id_, text)
    return read_ids(df.sparkSession, folder)
