"""Document fingerprints by consistent weighted sampling.

A text's terms are its words in lower case (ASCII letters), weighted by how often they occur times their length in bytes, so that a
function word counts for less than a rare one. For every term and sample, two gamma variables and a uniform one follow from a hash; they
turn the weight into a value, and the term with the least value is the sample, together with the step of its weight. Two texts have the
same sample with a probability equal to their generalised Jaccard similarity. The fingerprint holds 16 bits of each sample.

Defined cases: NULL and empty text have the fingerprint of zeros, equal to each other and like no other; equal ids are in the order of the first 64 signs of their texts,
then of a hash, repeated rows as they come; a row without id comes last; a single document is followed by itself. Extra columns are ignored. A very long text is one step: a task needs some 100 times its bytes,
so 20 MB are 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, slices, utf8
from .substrings import _mix, _range_hash, word_bounds

SAMPLES = 64
#: Text bytes of one vectorised step.
STEP = 600_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
FIRST_ID = -(1 << 63)


#: Samples drawn in one vector step, so that its arrays stay in the processor's cache.
COLUMNS = 8
_MASK = np.uint64((1 << 24) - 1)


def _uniform(bits: np.ndarray, shift: int) -> np.ndarray:
    """24 of the bits as values inside (0, 1)."""
    return ((bits >> np.uint64(shift) & _MASK).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def sample_values(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each weighted term (a row) and sample: the value in the upper half, the sample's identity in the lower."""
    out = np.empty((len(terms), samples), np.uint64)
    logs = np.log(weights.astype(np.float32))[:, None]
    for at in range(0, samples, COLUMNS):
        column = np.arange(at + 1, min(at + COLUMNS, samples) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        first = _mix(terms[:, None] ^ column)
        second = _mix(first + np.uint64(0x9E3779B97F4A7C15))
        third = _mix(second + np.uint64(0x9E3779B97F4A7C15))
        scale = -np.log(_uniform(first, 40) * _uniform(first, 16))
        value = np.log(-np.log(_uniform(second, 40) * _uniform(second, 16)))
        offset = _uniform(third, 40)
        step = np.floor(logs / scale + offset)
        value -= scale * (step - offset) + scale
        bits = value.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        identity = (third ^ step.astype(np.int64).view(np.uint64)) * np.uint64(0xA24BAED4963EE407) >> np.uint64(32)
        out[:, at : at + COLUMNS] = ordered << np.uint64(32) | identity
    return out


def signatures(texts: list[str | None], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples for each text."""
    data, bounds = utf8(pa.array(texts, pa.large_string()))
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, bounds)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(starts):
        return out
    words, where, number = np.unique(_range_hash(data, starts, ends), return_index=True, return_inverse=True)
    length = (ends - starts)[where]
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs, counts = np.unique(row << 32 | number, return_counts=True)
    term, row = pairs & 0xFFFFFFFF, pairs >> 32
    # Most texts hold a term as often as some other text does: each weighted term is drawn once.
    distinct, at = np.unique(term << 32 | counts, return_inverse=True)
    of = distinct >> 32
    values = sample_values(words[of], (distinct & 0xFFFFFFFF) * length[of], samples)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(values[at], begin, axis=0)
    out[row[begin]] = np.maximum(least & np.uint64(0xFFFF), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many from the start of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


_FINGERPRINT = "id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Rows in ranges of falling ids, each range sorted; Spark sizes the ranges by their rows and merges small ones by their bytes.

    Ties of an id are in the order of the first signs of their texts, then of a hash, so a hot id is many ranges; repeated rows are told apart by their number.
    """
    place = F.coalesce(F.col(id_).cast("long"), F.lit(FIRST_ID))
    plain = df.select(F.col(id_).alias("id"), place.alias("place"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("copy"))
    by = [F.desc("place"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("copy")]
    return plain.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "text")


def _compared(ids: list, texts: list[str], nexts: list[str], samples: int, kind: pa.DataType) -> dict[str, pa.Array]:
    """The result's columns for documents and those after them."""
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    # In a run of documents the next one's signature is needed anyway.
    distinct = list(dict.fromkeys([*texts, *nexts]))
    both = signatures(distinct + changed, samples)
    at = {t: i for i, t in enumerate(distinct)}
    own, then, other = both[[at[t] for t in texts]], both[[at[n] for n in nexts]], both[len(distinct) :]
    show = lambda prints: [p.astype(">u2").tobytes().hex() for p in prints]
    return {
        "id": pa.array(ids, kind), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        "fingerprint": pa.array(show(own)), "edited_fingerprint": pa.array(show(other)),
        "near_edited": pa.array(likeness(own, other)), "near_next": pa.array(likeness(own, then)),
    }


def fingerprint_rows(df: DataFrame, id_: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited version, and how alike these and the next document's are.

    A task has one range and compares each of its documents with the next. The last of a range meets the first of the next range in a second, small step: two texts for each range.
    """
    spark = df.sparkSession
    kind = df.schema[id_].dataType.simpleString()
    schema = _FINGERPRINT.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None
        type_ = None

        def edge(end: str, row: tuple) -> pa.RecordBatch:
            values = {"id": pa.array([row[0]], type_), "end": pa.array([end]), "part": pa.array([part], pa.int64()), "text": pa.array([row[1]], pa.string())}
            return _filled(values)

        for piece in slices(batches, "text", STEP):
            if not piece.num_rows:
                continue
            type_ = piece.schema.field("id").type
            rows = list(zip(piece.column("id").to_pylist(), [t or "" for t in piece.column("text").to_pylist()], strict=True))
            if last is None:
                yield edge("first", rows[0])
            else:
                rows.insert(0, last)
            last = rows[-1]
            if len(rows) > 1:
                ids, texts = zip(*rows, strict=True)
                yield _filled(_compared(list(ids[:-1]), list(texts[:-1]), list(texts[1:]), samples, type_))
        if last is not None:
            yield edge("last", last)

    made = stage(arrow_map(_in_order(df, id_, text), run, f"{schema}, end string, part long, text string"), "fingerprints")
    ends = made.where("end is not null").select("part", "end", "id", "text")
    # One number for each range.
    parts = sorted(r[0] for r in ends.where("end = 'first'").select("part").collect())
    follows = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part long, after long")
    firsts = ends.where("end = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    edges = ends.where("end = 'last'").join(F.broadcast(follows), "part").join(firsts, "after").select("id", "text", "next")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", STEP):
            ids, texts, nexts = (piece.column(c).to_pylist() for c in ("id", "text", "next"))
            yield pa.RecordBatch.from_pydict(_compared(ids, texts, nexts, samples, piece.schema.field("id").type))

    inner = made.where("end is null").drop("end", "part", "text")
    return inner.unionByName(arrow_map(edges, across, schema)).withColumnRenamed("id", id_)


_EMPTY = [
    ("id", None), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
    ("near_next", pa.float64()), ("end", pa.string()), ("part", pa.int64()), ("text", pa.string()),
]


def _filled(values: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of all columns; those that are not given are NULL."""
    n = len(values["id"])
    return pa.RecordBatch.from_pydict({name: values[name] if name in values else pa.nulls(n, type_) for name, type_ in _EMPTY})
