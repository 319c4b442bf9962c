"""The prefix trie of conversations: which turns they share from their start on, and what sharing them saves.

A conversation is the sequence of its turns; a node is a distinct start of such sequences, from the empty one, the root. Conversations are sorted by their turns'
digests into ranges. A range is one task: it numbers its distinct turns, lays the numbers out as matrices, one row a conversation, padded where a conversation has ended,
sorts the rows (``np.lexsort``) and marks where a column or one left of it differs from the row above. The marks of a column are the starts of the
nodes of that depth, and ``reduceat`` from mark to mark gives their aggregates. What a node's subtree adds up to is the sum of what begins, further right, in its rows.

Only the nodes on the paths of a range's first and last conversations can be in other ranges too. These boundary nodes, two paths a range, come out as parts, are
recombined by the digest of their path, and their subtrees added up: each is counted on one of the paths it is on, from the bottom up, and the paths through a node
are summed. The digest of the conversations that end in a node is computed where they are; for a boundary node the ranges hand on pieces, at most 2^16 ids each, in
ascending order, and one task streams them through the hash, as SHA-256 allows no other way; it holds one batch of pieces.

Matrices get wider from left to right while fewer conversations go on, so padding stays in proportion to the turns, however long one conversation is.

Defined cases: NULL turns come first, equal turns are in the order of their digests; NULL role or text counts as empty; rows without conversation id belong to
none and are left out; repeated rows are repeated turns; a conversation without turns ends in the root; no conversations have no nodes, not even a root. Extra columns are
ignored. A text of any length is digested by Spark where it is read. One conversation is one row from then on, 20 bytes a turn, so ten million turns are 200 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import parts_of, stage
from .common import arrow_map

#: Bytes of turn digests in one range, about.
RANGE_BYTES = 8 * 1024 * 1024
#: Columns of the first matrix of a range, and cells of a later one at most (but one column is always taken).
WIDTH, CELLS = 8, 1 << 20
#: Ids in one piece of a boundary node's conversations.
PIECE = 1 << 16
DIGEST = 16

_NODE, _PART, _PIECE = 0, 1, 2
_FOUND = (
    "kind int, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, path long, words long, ids binary"
)
_TYPES = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()),
])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 in hex for a role and a text."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def sequences(df: DataFrame, group: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``group``, ``conv`` and ``turns`` (in order: ``turn``, ``digest``, ``words``) of every conversation; one shuffle, by ``group``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = df.where(F.col(conv).isNotNull()).select(
        group.alias("group"), F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_digest(role, text).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    return turns.repartition("group").groupBy("group", "conv").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def as_paths(conv: Column, turns: Column) -> list[Column]:
    """The columns that ``trie`` takes: ``conv``, ``path`` (the digests, joined) and ``words`` (of each turn)."""
    joined = F.array_join(F.transform(turns, lambda t: t["digest"]), "")
    return [conv.alias("conv"), F.unhex(joined).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


class _Tile:
    """Some columns of the matrix: the sorted rows that reach them and, for each column, where its nodes start."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, group: np.ndarray, conv: np.ndarray, base: int):
        order = np.lexsort((conv, *ids.T[::-1], group))
        self.rows, self.ids, self.base = rows[order], ids[order], base
        group = group[order]
        mark = np.ones(ids.shape, bool)
        mark[1:] = self.ids[1:] != self.ids[:-1]
        mark[1:, 0] |= group[1:] != group[:-1]
        np.logical_or.accumulate(mark, axis=1, out=mark)
        self.starts = [np.flatnonzero(mark[:, j]) for j in range(ids.shape[1])]


class _Range:
    """The conversations of one range and the nodes they make."""

    def __init__(self, number: int, conv: np.ndarray, paths: list[bytes], words: np.ndarray):
        self.conv, self.number = conv, number
        self.length = np.array([len(p) // DIGEST for p in paths], np.int64)
        self.words = words
        self.begin = np.cumsum(self.length) - self.length
        self.turns = self._numbered(b"".join(paths))
        self.edges = [min(range(len(paths)), key=paths.__getitem__), max(range(len(paths)), key=paths.__getitem__)]
        self.keys = [self._keys(paths[e]) for e in self.edges]
        # How deep the two paths are one.
        self.common = 0
        while self.common < min(map(len, self.keys)) and self.keys[0][self.common] == self.keys[1][self.common]:
            self.common += 1
        self.tiles = self._tiles()

    @staticmethod
    def _numbered(data: bytes) -> np.ndarray:
        """Distinct turns as small numbers."""
        high, low = np.frombuffer(data, ">u8").reshape(-1, 2).T
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        out = np.empty(len(order), np.int32)
        out[order] = np.cumsum(new) - 1
        return out

    @staticmethod
    def _keys(path: bytes) -> list[bytes]:
        """The digest of each start of a path, the empty one first."""
        state = hashlib.sha256()
        out = [state.digest()]
        for at in range(0, len(path), DIGEST):
            state.update(path[at : at + DIGEST])
            out.append(state.copy().digest())
        return out

    def _tiles(self) -> list[_Tile]:
        tiles, base, width = [], 0, WIDTH
        group = np.zeros(len(self.conv), np.int64)
        rows = np.flatnonzero(self.length > 0)
        while len(rows):
            left = self.length[rows] - base
            wide = min(max(1, min(width, CELLS // len(rows))), int(left.max()))
            ids = np.full((len(rows), wide), -1, np.int32)
            take = np.minimum(left, wide)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            row = np.repeat(np.arange(len(rows)), take)
            ids[row, at] = self.turns[self.begin[rows][row] + base + at]
            tile = _Tile(rows, ids, group[rows], self.conv[rows], base)
            tiles.append(tile)
            last = np.zeros(len(rows), np.int64)
            last[tile.starts[-1]] = 1
            group[tile.rows] = np.cumsum(last)
            base, width = base + wide, 2 * width
            rows = rows[self.length[rows] > base]
        return tiles

    def _ends(self, tile: _Tile, depth: int, starts: np.ndarray) -> list[tuple[int, list[int]]]:
        """Number of the node and ascending ids for each node of this depth where conversations end."""
        done = np.flatnonzero(self.length[tile.rows] == depth)
        if not len(done):
            return []
        node = np.searchsorted(starts, done, side="right") - 1
        conv = self.conv[tile.rows[done]]
        cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
        return [(int(n[0]), ids.tolist()) for n, ids in zip(np.split(node, cuts), np.split(conv, cuts), strict=True)]

    def _pieces(self, key: bytes, ids: list[int]) -> Iterator[dict]:
        for at in range(0, len(ids), PIECE):
            some = ids[at : at + PIECE]
            yield {"kind": _PIECE, "key": key, "conv_id": some[0], "ids": ",".join(map(str, some)).encode()}

    def _part(self, side: int, depth: int, **values) -> dict:
        keys = self.keys[side]
        empty = {"conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "words": 0}
        return {"kind": _PART, "path": 2 * self.number + side, "depth": depth, "key": keys[depth], "parent_key": keys[depth - 1] if depth else None} | empty | values

    def found(self) -> Iterator[pa.RecordBatch]:
        """All nodes, parts of nodes and pieces of ids, the deepest first."""
        n = len(self.conv)
        # What begins in a row at greater depths: childless nodes, saved tokens; and whether a node of the next depth does.
        leaves, saved, child = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        others: list[dict] = []
        for k in reversed(range(len(self.tiles))):
            tile = self.tiles[k]
            rows, conv = tile.rows, self.conv[tile.rows]
            spot = np.full(n, -1)
            spot[rows] = np.arange(len(rows))
            for j in reversed(range(tile.ids.shape[1])):
                depth, starts = tile.base + j + 1, tile.starts[j]
                real = tile.ids[starts, j] >= 0
                n_convs = np.diff(starts, append=len(rows))
                first = np.minimum.reduceat(conv, starts)
                children = np.add.reduceat(child[rows].astype(np.int64), starts)
                below, tokens = np.add.reduceat(leaves[rows], starts), np.add.reduceat(saved[rows], starts)
                top = rows[starts]
                # Padding has no words.
                words = np.zeros(len(starts), np.int64)
                words[real] = self.words[self.begin[top[real]] + depth - 1]
                node_of = lambda side: int(np.searchsorted(starts, spot[self.edges[side]], side="right")) - 1  # noqa: B023, E731
                edge = [node_of(side) if self.length[self.edges[side]] >= depth else -1 for side in (0, 1)]
                shared = np.zeros(len(starts), bool)
                shared[[e for e in edge if e >= 0]] = True
                own = real & ~shared
                ends = dict(self._ends(tile, depth, starts))
                for side in (0, 1):
                    if edge[side] < 0:
                        continue
                    at = edge[side]
                    # Where both paths are one, the first has the node's part.
                    values = {} if side and depth < self.common else {
                        "conv_id": int(first[at]), "n_convs": int(n_convs[at]), "n_children": int(children[at]), "n_leaves": int(below[at]), "saved_tokens": int(tokens[at]), "words": int(words[at]),
                    }
                    others.append(self._part(side, depth, **values))
                    if values:
                        others += self._pieces(self.keys[side][depth], ends.get(at, []))
                # Back to how a row's part changes here: a node of its own begins.
                leaf, tokens_own = children == 0, (n_convs - 1) * words
                leaves[top[own]] += leaf[own]
                saved[top[own]] += tokens_own[own]
                child[rows] = False
                child[top[own]] = True
                if own.any():
                    yield self._nodes(k, j, own, starts, depth, first, n_convs, children, below + leaf, tokens + tokens_own, ends)
                if len(others) >= 1 << 14:
                    yield pa.RecordBatch.from_pylist(others, _TYPES)
                    others = []
        ends = np.sort(self.conv[self.length == 0]).tolist()
        root = {"conv_id": int(self.conv.min()), "n_convs": n, "n_children": int(child.sum()), "n_leaves": int(leaves.sum()), "saved_tokens": int(saved.sum())}
        others += [self._part(0, 0, **root), self._part(1, 0), *self._pieces(self.keys[0][0], ends)]
        yield pa.RecordBatch.from_pylist(others, _TYPES)

    def _nodes(self, k, j, own, starts, depth, first, n_convs, children, n_leaves, tokens, ends) -> pa.RecordBatch:
        at = np.flatnonzero(own)
        parent, shared = self._parents(k, j, starts[at], depth)
        digests = [_NO_ENDS] * len(at)
        place = dict(zip(at.tolist(), range(len(at)), strict=True))
        for node, ids in ends.items():
            if node in place:
                digests[place[node]] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        columns = {
            "kind": np.full(len(at), _NODE), "conv_id": first[at], "depth": np.full(len(at), depth), "n_convs": n_convs[at], "n_children": children[at],
            "n_leaves": n_leaves[at], "saved_tokens": tokens[at],
        }
        keys = np.array([None, *(keys[depth - 1] if len(keys) >= depth else None for keys in self.keys)], object)[shared]
        made = {c: pa.array(v, _TYPES.field(c).type) for c, v in columns.items()}
        made |= {"parent_conv_id": pa.array(parent, mask=shared > 0), "parent_key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(digests)}
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(at), f.type) for f in _TYPES], schema=_TYPES)

    def _parents(self, k: int, j: int, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The least conversation of each node's parent, and 1 or 2 where the parent is on the first or last path of the range."""
        if depth == 1:
            return np.zeros(len(starts), np.int64), np.ones(len(starts), np.int8)
        tile, rows = self.tiles[k], self.tiles[k].rows[starts]
        if j == 0:
            tile = self.tiles[k - 1]
            spot = np.full(len(self.conv), -1)
            spot[tile.rows] = np.arange(len(tile.rows))
            at, above = spot[rows], tile.starts[-1]
        else:
            spot, at, above = None, starts, tile.starts[j - 1]
        node = np.searchsorted(above, at, side="right") - 1
        shared = np.zeros(len(starts), np.int8)
        for side in (1, 0):
            row = self.edges[side]
            if self.length[row] >= depth - 1:
                place = int(np.flatnonzero(tile.rows == row)[0])
                shared[node == np.searchsorted(above, place, side="right") - 1] = side + 1
        return np.minimum.reduceat(self.conv[tile.rows], above)[node], shared


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    words = pc.list_flatten(rows["words"]).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    yield from _Range(TaskContext.get().partitionId(), rows["conv"].to_numpy(), rows["path"].to_pylist(), words).found()


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids of each key, whose pieces come one after the other."""
    key = state = None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _boundary(found: DataFrame) -> DataFrame:
    """The nodes that ranges share, recombined, with ``key`` and ``parent_key``."""
    parts = found.where(F.col("kind") == _PART)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = parts.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *sums, F.max("words").alias("words"), F.min("path").alias("path")
    )
    nodes = stage(nodes, "boundary")
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens")
    nodes = stage(nodes.select("*", *own), "boundary")
    # Each node counts on the least path it is on; a path's sums from the bottom up are those of what it counts in the subtree.
    counted = nodes.select("key", "path", "leaf", "tokens")
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paths = parts.select("path", "depth", "key").join(counted, ["key", "path"], "left")
    paths = paths.select("key", *[F.sum(F.coalesce(c, F.lit(0))).over(below).alias(c) for c in ("leaf", "tokens")])
    totals = paths.groupBy("key").agg(F.sum("leaf").alias("leaves"), F.sum("tokens").alias("saved"))
    pieces = found.where(F.col("kind") == _PIECE).select("key", "conv_id", "ids")
    ends = arrow_map(pieces.repartition("key").sortWithinPartitions("key", "conv_id"), _stream_digests, "key binary, ends_sha256 string")
    joined = nodes.drop("leaf", "tokens", "path").join(totals, "key").join(ends, "key", "left")
    return joined.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def trie(paths: DataFrame, range_bytes: int = RANGE_BYTES, ranges: int | None = None) -> DataFrame:
    """The nodes of the conversations in ``paths`` (``conv``, ``path``, ``words``; a stored table): ``conv_id`` (the least of its members), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    # Ranges by bytes, but no fewer than the session's tasks.
    ranges = ranges or max(parts_of(paths, range_bytes), int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = paths.repartitionByRange(ranges, "path", "conv").select("conv", "path", "words")
    found = stage(arrow_map(dealt, _ranges, _FOUND), "nodes")
    shared = stage(_boundary(found), "shared")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.where(F.col("kind") == _NODE)
    closed = inner.where("parent_key is null").select(columns)
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    below = lookup_join(inner.where("parent_key is not null"), parents, "parent_key").withColumn("parent_conv_id", F.col("parent")).select(columns)
    edges = lookup_join(shared, parents, "parent_key", "left").withColumn("parent_conv_id", F.col("parent")).select(columns)
    return closed.unionByName(below).unionByName(edges)
