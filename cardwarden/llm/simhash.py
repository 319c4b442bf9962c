"""SimHash near-duplicates, compared on vertical bit planes.

A document's fingerprint holds the majority bit of the hashes of its word shingles. Equal
fingerprints are merged first, so a group of copies is one row from then on. Two fingerprints
within the radius agree on all but ``radius`` of their eight bytes, hence share a bucket for some choice of the
bytes left out. A bucket of distinct fingerprints has at most 2**(8 * radius) members, whatever the input. Inside
a bucket, bit planes are compared 64 fingerprints at a time.

Defined cases: NULL and empty text have no words and fingerprint zero, which links like any other;
a text shorter than a shingle is one shingle; repeated rows are repeated in the result; a
row without id gets a fingerprint, no component, and links nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, slices

WORDS = 3
RADIUS = 2
SEED = 42
BLOCKS = 8
#: Entries (a fingerprint against 64 others) compared in one vector step.
STEP = 1 << 18
#: Bucket entries that a task makes, about.
ENTRIES = 1 << 21
#: Planes between two looks for entries that are beyond the radius in every lane.
PLANES_PER_LOOK = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each document, whose hashes are next to one another."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate([[0], np.cumsum(counts)])[full]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little")
    out[full] = packed.view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``id_`` and ``fingerprint``, a long with the 64 bits, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes = [shingle_hashes(t, words) for t in part.column("text").to_pylist()]
            counts = np.array([len(h) for h in hashes])
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, counts.sum())
            prints = majority(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints)], ["id", "fingerprint"])

    kind = df.schema[id_].dataType.simpleString()
    plain = df.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return arrow_map(plain, run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_)


def close_pairs(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within ``radius`` bits inside each bucket of ``sizes`` values.

    Each bucket fills words of 64 lanes. A counter of few bits per lane, held as whole planes and
    added to with carries, starts so that it overflows at ``radius + 1``.
    """
    n = len(values)
    if not n:
        return
    starts = np.cumsum(sizes) - sizes
    rank = np.arange(n) - np.repeat(starts, sizes)
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    word = np.repeat(first_word, sizes) + rank // 64
    lane = (rank % 64).astype(np.uint64)
    word_start = np.flatnonzero(rank % 64 == 0)
    one = np.uint64(1)
    planes = [np.bitwise_or.reduceat((values >> np.uint64(b) & one) << lane, word_start) for b in range(64)]
    valid = np.bitwise_or.reduceat(one << lane, word_start)
    against = np.repeat(first_word + words, sizes) - word
    counters = radius.bit_length()
    begin = (1 << counters) - (radius + 1)
    total = np.cumsum(against)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + STEP, side="right")))
        query = np.repeat(np.arange(at, stop), against[at:stop])
        other = np.arange(len(query)) - np.repeat(total[at:stop] - against[at:stop] - done, against[at:stop]) + word[query]
        own = other == word[query]
        upto = np.where(lane[query] == 63, ALL, (one << (lane[query] + one & np.uint64(63))) - one)
        dead = ~valid[other] | np.where(own, upto, np.uint64(0))
        count = [np.full(len(query), ALL if begin >> k & 1 else 0, np.uint64) for k in range(counters)]
        at = stop
        for b in range(64):
            if b % PLANES_PER_LOOK == 0:
                alive = dead != ALL
                if not alive.all():
                    query, other, dead = query[alive], other[alive], dead[alive]
                    count = [c[alive] for c in count]
                if not len(query):
                    break
            carry = planes[b][other] ^ (np.uint64(0) - (values[query] >> np.uint64(b) & one))
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            dead |= carry
        found = np.unpackbits((~dead).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        entry, bit = np.nonzero(found)
        if len(entry):
            to = word_start[other[entry]] + bit
            yield query[entry], to


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``u > v`` of distinct fingerprints within the radius.

    ``prints`` has distinct longs in ``fingerprint``.
    """
    masks = []
    for out in combinations(range(BLOCKS), radius):
        mask = sum(0xFF << 8 * b for b in range(BLOCKS) if b not in out)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[
        F.struct(F.lit(i).alias("out"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)
    ])
    # The rows are few bytes that grow with the number of choices; tasks by their size in the files would be too few.
    parts = max(prints.sparkSession.sparkContext.defaultParallelism, prints.count() * len(masks) // ENTRIES + 1)
    buckets = (
        prints.repartition(parts, "fingerprint").select("fingerprint", F.explode(keys).alias("k"))
        .groupBy("k.out", "k.key")
        .agg(F.collect_list("fingerprint").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                lists = batch.column(0).slice(at, 5000)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                for a, b in close_pairs(values.view(np.uint64), sizes, radius):
                    u, v = np.maximum(values[a], values[b]), np.minimum(values[a], values[b])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return arrow_map(buckets, run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of an edge.

    Edges are turned into stars round the least node, alternately over the larger and the smaller neighbours, until nothing
    changes. Least neighbours come from an aggregate and a join, so that a hub is no group of rows.
    """

    def settle(e: DataFrame) -> tuple[DataFrame, tuple]:
        kept = stage(e.distinct(), "edges")
        state = kept.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return kept, tuple(state)

    edges, before = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large, _ = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = settle(small.unionByName(least.select("u", F.col("m").alias("v"))))
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(
    df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """``id_``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id reachable."""
    prints = stage(fingerprints(df, id_, text, words), "prints")
    classes = stage(prints.where(F.col(id_).isNotNull()).groupBy("fingerprint").agg(F.min(id_).alias("least")), "classes")
    grouped = components(links(classes.select("fingerprint"), radius))
    rooted = classes.join(grouped, classes.fingerprint == grouped.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stage(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stage(rooted.join(lowest, "root").select("fingerprint", "component_id"), "found")
    out = prints.join(found, "fingerprint", "left")
    component = F.when(F.col(id_).isNotNull(), F.col("component_id"))
    return out.select(
        id_,
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
    )
