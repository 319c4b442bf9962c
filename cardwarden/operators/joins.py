"""Joins of a large table with a lookup table, whatever the sizes and however skewed the keys."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Copies of a lookup row, each for one share of a hot key's rows, where a stream asks for them.
SALTS = 16

#: Rows of a result that one task makes, about, where keys repeat on both sides; and the most parts such a result is dealt to.
PAIR_ROWS = 2_000_000
PAIR_PARTS = 10_000


def lookup_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", salts: int = 1
) -> DataFrame:
    """Join ``left`` with the lookup table ``right``; ``how`` is inner, left, left_semi or left_anti.

    Each side is read once. Spark sends ``right`` to every executor if its size, known from the
    files or from the shuffle that wrote it, is under the session's broadcast thresholds, and
    ``left`` is then not shuffled. Otherwise both sides are shuffled by key, and adaptive execution
    splits the partitions that hot keys, NULL included, have made too large.

    A streaming query is not executed adaptively. Where its lookup table is too large to broadcast,
    ``salts`` deals the rows of a key to that many tasks, by a hash of the row, with a copy of the
    lookup row for each.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if salts == 1:
        return left.join(right, keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, on: str, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Left join where a key may repeat on both sides, so that the result may be far larger than the tables are.

    Adaptive execution deals tasks by the bytes they read and would leave a hot key's pairs to one. Here the rows of the result are counted by key first;
    each task makes about ``pair_rows`` of them. A hot key's pairs are a rectangle of left and right rows, cut along both sides into squares of about that many:
    its left rows are dealt to shares and its right rows to blocks, and each share has a copy of each block. So what is moved grows with the root of a task's pairs,
    and a task holds the right rows of one block. Both sides are stored first, with a number in each row that it is dealt by, so that equal rows part too.
    """
    numbered = F.monotonically_increasing_id()
    names = [c for c in left.columns if c != on]
    left = stage(left.withColumn("_row", numbered), "left")
    right = stage(right.where(F.col(on).isNotNull()).withColumn("_row", numbered), "right")
    sizes = left.groupBy(on).agg(F.count(F.lit(1)).alias("_left")).join(right.groupBy(on).agg(F.count(F.lit(1)).alias("_right")), on, "full")
    pairs = F.coalesce("_left", F.lit(0)) * F.coalesce("_right", F.lit(1))
    sizes = stage(sizes.select(F.col(on).alias("_hot"), F.coalesce("_right", F.lit(0)).alias("_right"), pairs.alias("_pairs")), "sizes")
    total = sizes.agg(F.sum("_pairs")).first()[0] or 0
    share = max(pair_rows, -(-total // PAIR_PARTS))
    side = isqrt(share)
    # At most as many keys as there are parts and as the right side has blocks.
    hot = sizes.where((F.col("_pairs") > share) | (F.col("_right") > side))
    hot = hot.withColumn("_blocks", F.greatest(F.ceil(F.col("_right") / side), F.lit(1)).cast("int"))
    hot = F.broadcast(hot.select("_hot", "_blocks", F.greatest(F.ceil(F.col("_pairs") / share / F.col("_blocks")), F.lit(1)).cast("int").alias("_shares")))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col(on).eqNullSafe(F.col("_hot")), "left").drop("_hot").fillna(1, ["_blocks", "_shares"])

    def dealt(to: str) -> Column:
        return F.pmod(F.xxhash64("_row"), F.col(to)).cast("int")

    def copied(to: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(to) - 1))

    parts, keys = max(1, -(-total // share)), [on, "_share", "_block"]
    left = marked(left).withColumn("_share", dealt("_shares")).withColumn("_block", copied("_blocks"))
    values = F.struct(*[c for c in right.columns if c not in (on, "_row")] or ["_row"])
    blocks = marked(right).groupBy(on, dealt("_blocks").alias("_block"), "_shares").agg(F.collect_list(values).alias("_rows"))
    blocks = blocks.withColumn("_share", copied("_shares")).select(*keys, "_rows")
    joined = left.select(*keys, "_blocks", *names).repartition(parts, *keys).join(blocks.repartition(parts, *keys), keys, "left")
    # A key cut into blocks has right rows; a block left empty gives it none.
    joined = joined.where((F.col("_blocks") == 1) | F.col("_rows").isNotNull())
    return joined.select(on, *names, F.inline_outer("_rows")).drop("_row")
