"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays in one shard. A partial partition is a tuple of as many sums as there are
shards; a group starts as one with its bytes in a single slot. Differencing takes the two partial
partitions with the largest spread and adds them oppositely ordered, until one is left.

That is done in rounds so that no task holds all groups: each bucket of some thousand partial
partitions is combined to one, the results are dealt to new buckets, until one is left. A round keeps, for each partial partition,
the slot of the result each of its slots went to; the shard of a group follows these from the last round back to the first.

Defined cases: NULL and empty text are one group of size 1 per row; repeated rows are one group; an empty table gives an
empty result; groups beyond an even share keep their shard alone as far as can be. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

SHARDS = 16
#: Partial partitions that one task combines.
BUCKET = 4096


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine the rows of ``sums`` (partial partitions by slots) into one.

    Returns its sums in falling order, and the slot of the result that each slot of each row went to.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    parts = {i: (np.take_along_axis(sums[i], order[i], 0), [[(i, int(s))] for s in order[i]]) for i in range(n)}
    heap = [(-int(p[0][0] - p[0][-1]), i) for i, p in parts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (x, of_x), (y, of_y) = parts.pop(a), parts.pop(b)
        both = x + y[::-1]
        slots = []
        for p, q in zip(of_x, reversed(of_y), strict=True):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            slots.append(p)
        turn = np.argsort(-both, kind="stable")
        parts[a] = (both[turn], [slots[t] for t in turn])
        heapq.heappush(heap, (-int(both[turn[0]] - both[turn[-1]]), a))
    (total, slots), = parts.values()
    went = np.zeros((n, k), np.int32)
    for s, members in enumerate(slots):
        for i, own in members:
            went[i, own] = s
    return total, went


def _round(parts: DataFrame, buckets: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Combine ``parts`` (``part``, ``sums``) by bucket: their slots in the results, and the results."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        total, went = difference(np.stack(pdf["sums"].to_numpy()))
        return pd.DataFrame({"part": pdf["part"], "bucket": pdf["bucket"], "went": list(went), "total": [total, *[None] * (len(pdf) - 1)]})

    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("part", F.lit(buckets)), F.lit(buckets)))
    made = dealt.groupBy("bucket").applyInPandas(combine, "part string, bucket long, went array<int>, total array<long>")
    made = stage(made, "round")
    results = made.where("total is not null").select(F.col("bucket").cast("string").alias("part"), F.col("total").alias("sums"))
    return made.select("part", F.col("bucket").cast("string").alias("parent"), "went"), results


def assign(groups: DataFrame, key: str, size: str, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """``key`` and ``shard`` for each row of ``groups``, whose keys (text) are distinct."""
    first = F.array(F.col(size).cast("long"), *[F.lit(0).cast("long")] * (shards - 1))
    parts = groups.select(F.col(key).alias("part"), first.alias("sums"))
    left = groups.count()
    rounds = []
    while True:
        buckets = -(-left // bucket)
        went, parts = _round(parts, max(buckets, 1), shards)
        rounds.append(went)
        if buckets <= 1:
            break
        left = buckets
    # From the last round back: the shard that each slot of a partial partition ended in.
    last = rounds.pop()
    ends = last.select("part", F.col("went").alias("ends"))
    while rounds:
        below = rounds.pop().withColumnRenamed("part", "child")
        ends = below.join(ends, below.parent == ends.part).select(
            F.col("child").alias("part"),
            F.transform("went", lambda s: F.element_at("ends", s + 1)).alias("ends"),
        )
    return ends.select(F.col("part").alias(key), F.element_at("ends", 1).alias("shard"))


def number(df: DataFrame, shard: str = "shard", shards: int = SHARDS) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, in the order of the table that this writes.

    A task counts the rows of each shard as it passes them on; the few totals of each
    task, added up in order, are where its numbers begin. So no shard is gathered in one task.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())])
    at = df.columns.index(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=shards)
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            columns = [*batch.columns, pa.array(np.full(len(own), task, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    counted = stage(df.mapInArrow(run, schema), "counted")
    totals = counted.groupBy(shard, "_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(shard, "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    joined = counted.join(begins, [shard, "_task"])
    return joined.withColumn("slot", F.col("_from") + F.col("_nth")).drop("_from", "_nth", "_task")


def shard_rows(df: DataFrame, id_: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``id_``, ``size`` (bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``."""
    plain = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = stage(df.select(
        F.col(id_).alias("id"),
        (F.length(plain) + 1).cast("long").alias("size"),
        F.crc32(plain).alias("text_crc32"),
        F.sha2(plain, 256).alias("digest"),
    ), "sized")
    groups = stage(sized.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    shards_of = stage(assign(groups, "digest", "bytes", shards), "shards")
    placed = sized.join(shards_of, "digest").select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    return number(placed, shards=shards).select(
        F.col("id").alias(id_), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
