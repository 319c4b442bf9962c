"""A Merkle manifest of a data set: one root for all rows, and for each row the proof that it is under that root.

The rows of a tree (here: of a language) are its leaves, in order; every 8 neighbours become their digest until one is left. The tops of all trees, in the order
of their names, are the leaves of one last tree, whose top is the root. Digests are of the SHA-256 hex digits of what is below, one after the other.

Only every third level is stored (``EVERY``). A stored node and the stored nodes below it span an aligned subtree of at most 512 leaves, which is one
group for Spark. Going up, a group regenerates its levels from the stored ones below and hands on its top alone. Going down, it regenerates them again, gives each of its
leaves the siblings on the way up, followed by the proof of the subtree's own top, and forgets them. So no group or task holds more than a subtree, and
there are as many rounds as the number of leaves has digits to the base 512.

Positions come from a range partitioning that splits any tree, however many rows it has; repeated rows are told apart by a number that is written with them.

Defined cases: rows of a tree without id come first; equal ids follow their leaves' digests, and repeated rows have proofs of their own; the rows without a name are a
tree, before all others; a lone leaf is its tree's top, and a lone top is the root; an empty table has no root and gives no rows. Extra columns are ignored.
A text of any length is one row and is digested by Spark where it is read; it moves nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import stage

#: Children of a node, and levels from one stored level to the next.
FAN = 8
EVERY = 3
#: What a leaf is the digest of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_INDEX_BITS = 33


class Forest(NamedTuple):
    """Stored levels of trees, from the leaves up: ``tree``, ``pos``, ``size`` (nodes of the tree on this level) and ``digest``."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        tops = [level.where("size = 1").select("tree", "digest") for level in self.levels]
        all_ = tops[0]
        for more in tops[1:]:
            all_ = all_.unionByName(more)
        return all_


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields of a row, each with its length in bytes, or ``-`` for NULL."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_name(column: Column) -> Column:
    """A name that is never NULL and orders NULL first."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit(""))


def place(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` and ``size`` within each ``tree``, by the columns ``order``.

    Leaves are sorted in ranges. Spark's row number says which range a row is in and where; the sizes of the ranges and the trees, one row for each, do the rest.
    """
    marked = stage(leaves.withColumn("copy", F.monotonically_increasing_id()), "marked")
    by = ["tree", *order, "copy"]
    ranged = marked.repartitionByRange(*by).sortWithinPartitions(*by).drop("copy")
    ordered = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")
    own, nth = F.shiftright("at", _INDEX_BITS), F.col("at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy(own.alias("range")).agg(F.count("*").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ordered.withColumn("range", own).join(F.broadcast(ranges), "range").withColumn("at", F.col("before") + nth).drop("range", "before")
    trees = stage(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("size")), "trees")
    return lookup_join(placed, trees, "tree").withColumn("pos", F.col("at") - F.col("first")).drop("at", "first")


def _levels(digests: list[bytes], size: int) -> tuple[list[list[str]], int]:
    """The levels of an aligned subtree up to the next stored one, as hex digits, and the nodes of the whole tree there."""
    levels = [[d.hex() for d in digests]]
    while len(levels) <= EVERY and size > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
        size = -(-size // FAN)
    return levels, size


def _block(pos: Column) -> Column:
    return F.floor(pos / F.lit(FAN**EVERY)).cast("long")


def _up(level: DataFrame) -> DataFrame:
    """The stored level above; trees that have ended are left out."""

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        levels, size = _levels(rows["digest"].to_pylist(), rows["size"][0].as_py())
        top = [key[0].as_py()], [key[1].as_py()], [size], [bytes.fromhex(levels[-1][0])]
        return pa.table([pa.array(v, t) for v, t in zip(top, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["tree", "pos", "size", "digest"])

    nodes = level.where("size > 1").select("tree", "pos", "size", "digest").withColumn("block", _block(F.col("pos")))
    return nodes.groupBy("tree", "block").applyInArrow(fold, "tree string, pos long, size long, digest binary")


def grow(leaves: DataFrame) -> Forest:
    """The stored levels over placed leaves."""
    levels = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(stage(_up(levels[-1]), "level"))
        most = -(-most // FAN**EVERY)
    return Forest(levels)


def _down(level: DataFrame, above: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Proofs of the nodes of a stored level from those of the level above."""
    nodes = level.where("size > 1").withColumn("block", _block(F.col("pos")))
    proven = above.select("tree", F.col("pos").alias("block"), "left", "right", "top")
    kept = [f for f in level.schema.fields if f.name in carry]
    schema = "tree string, pos long, digest binary, left array<string>, right array<string>, top binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)

    def extend(rows: pa.Table, up: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        names = ["tree", "pos", "digest", "left", "right", "top", *[f.name for f in kept]]
        if not rows.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.binary()), *[pa.array([], pa.list_(pa.string()))] * 2, pa.array([], pa.binary()),
                             *[rows[f.name] for f in kept]], names)
        levels, _ = _levels(rows["digest"].to_pylist(), rows["size"][0].as_py())
        sides = []
        for nodes in levels[:-1]:
            runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
            sides.append(([["".join(r[:i]) for i in range(len(r))] for r in runs], [["".join(r[i + 1 :]) for i in range(len(r))] for r in runs]))
        more = up["left"][0].as_py(), up["right"][0].as_py()
        proofs = [[[side[s][i // FAN ** (k + 1)][i // FAN**k % FAN] for k, side in enumerate(sides)] + more[s] for i in range(rows.num_rows)] for s in (0, 1)]
        made = [pa.array(p, pa.list_(pa.string())) for p in proofs]
        top = pa.array([up["top"][0].as_py()] * rows.num_rows, pa.binary())
        return pa.table([rows["tree"], rows["pos"], rows["digest"], *made, top, *[rows[f.name] for f in kept]], names)

    grouped = nodes.groupBy("tree", "block").cogroup(proven.groupBy("tree", "block"))
    return grouped.applyInArrow(extend, schema)


def prove(forest: Forest, above: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``tree``, ``pos``, ``digest``, ``left``, ``right``, ``top`` and the columns ``carry`` of every leaf.

    ``left`` and ``right`` have, level by level, the siblings before and after; ``top`` is the tree's. ``above`` has these
    two, from the top on, for each ``tree``.
    """
    proofs = None
    for depth in reversed(range(len(forest.levels))):
        level = forest.levels[depth]
        names = ["tree", "pos", "digest", "left", "right", "top", *(c for c in carry if c in level.columns)]
        found = lookup_join(level.where("size = 1"), above, "tree").withColumn("top", F.col("digest")).select(*names)
        if proofs is not None:
            found = found.unionByName(_down(level, proofs, carry).select(*names))
        proofs = stage(found, "proofs") if depth else found
    return proofs


def manifest(leaves: DataFrame, order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The proofs of ``leaves`` (``tree``, ``digest``, the columns of ``order`` and ``carry``), as ``prove`` gives them, and the ``root`` of all."""
    spark = leaves.sparkSession
    lower = grow(place(leaves, order))
    tops = stage(lower.tops(), "tops")
    # The tops are the leaves of one more tree, in the order of their names.
    upper = grow(stage(place(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "tops"))
    nothing = spark.createDataFrame([("", [], [])], "tree string, left array<string>, right array<string>")
    above = stage(prove(upper, nothing, ["name"]), "above")
    found = prove(lower, above.select(F.col("name").alias("tree"), "left", "right"), carry)
    root = upper.tops().first()
    return found.withColumn("root", F.lit(bytearray(root["digest"]) if root else None).cast("binary"))


def proof_digest(left: str = "left", right: str = "right") -> Column:
    """Digest of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def folded(leaf: Column, left: str = "left", right: str = "right") -> Column:
    """The root that a leaf's hex digest and the siblings of its proof lead to."""
    return F.aggregate(F.arrays_zip(left, right), leaf, lambda node, s: F.sha2(F.concat(s[left], node, s[right]), 256))
