"""A table of unique keys to which only new rows are added, without a scan of the keys it has.

Files are hash buckets of what one load added. Beside them lies an index, a row for each file: least and greatest key, and a Bloom filter of its keys, ten bits each. A load sends its
distinct keys to the index rows of their bucket. A key that is outside all bounds or filters there is new for certain; the files that may hold one of the others, some
hundredth of what is new and all that is not, are read, and nothing else of the table is. Files, index and the commit that names both go together (``commits``), so readers see
whole loads, and a replayed load adds nothing.

Of a new key that a load brings twice, one row stays, the greatest by all columns that can be ordered. Rows without key are left out, as they could never be found again. A bucket's files are as many
as there were loads since ``squash``, which rewrites the buckets that have too many.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_scope, stage
from .commits import CommitLog, State

BITS_PER_KEY = 10
HASHES = 7


def _spots(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Places of keys in a filter of ``size`` bits, a column for each hash function."""
    step = np.arange(HASHES, dtype=np.uint64)
    return (h1.view(np.uint64)[:, None] + step * (h2.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(size)


def bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    bits = np.zeros(-(-max(64, BITS_PER_KEY * len(h1)) // 8) * 8, np.uint8)
    bits[_spots(h1, h2, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(filter_, np.uint8)
    spots = _spots(h1, h2, 8 * len(raw))
    return (raw[spots >> np.uint64(3)] >> (np.uint64(7) - (spots & np.uint64(7))).astype(np.uint8) & 1).all(axis=1)


class IndexedTable:
    """The table in the folder ``target`` with the columns of ``schema``, unique in ``key``."""

    def __init__(self, spark: SparkSession, target: str, schema: T.StructType, key: str, buckets: int = 16):
        self.spark, self.target, self.schema, self.key, self.buckets = spark, target.rstrip("/"), schema, key, buckets
        self.log = CommitLog(spark, self.target)
        self.kind = schema[key].dataType.simpleString()
        #: Files that the last load had to read, and those the table had then.
        self.files_read: tuple[int, int] = (0, 0)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        h1 = F.xxhash64(self.key)
        return rows.withColumns({"_h1": h1, "_h2": F.xxhash64(self.key, F.lit(7)), "_bucket": F.pmod(h1, F.lit(self.buckets)).cast("int")})

    def _paths(self, state: State, prefix: str) -> list[str]:
        return [f"{self.target}/{name}" for name in state.live if name.startswith(prefix)]

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._paths(self.log.state(), "data/"))

    def _index_schema(self) -> str:
        return f"_bucket int, file string, low {self.kind}, high {self.kind}, n long, bloom binary"

    def _write(self, rows: DataFrame) -> tuple[list[str], str]:
        """Files and index of new rows: their names."""
        load = uuid.uuid4().hex
        folder, index = f"data/{load}", f"index/{load}"
        rows = stage(self._hashed(rows), "new")
        found = [r[0] for r in rows.select("_bucket").distinct().collect()]
        if not found:
            return [], index
        rows.repartition(len(found), "_bucket").sortWithinPartitions("_bucket").select(*self.schema.names, "_bucket").write.partitionBy("_bucket").parquet(f"{self.target}/{folder}")
        kind = pa.schema([("_bucket", pa.int32()), ("bloom", pa.binary())])

        def filters(key: tuple, keys: pa.Table) -> pa.Table:
            h1, h2 = (keys[c].to_numpy() for c in ("_h1", "_h2"))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([bloom(h1, h2)], pa.binary())], schema=kind)

        made = rows.select("_bucket", "_h1", "_h2").groupBy("_bucket").applyInArrow(filters, "_bucket int, bloom binary")
        bounds = rows.groupBy("_bucket").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("n"))
        file = F.concat(F.lit(f"{folder}/_bucket="), F.col("_bucket").cast("string"))
        bounds.join(made, "_bucket").select("_bucket", file.alias("file"), "low", "high", "n", "bloom").write.parquet(f"{self.target}/{index}")
        return [f"{folder}/_bucket={b}" for b in found], index

    def _suspects(self, keys: DataFrame, state: State) -> DataFrame:
        """``file`` and key of those keys that a file may hold."""
        paths = self._paths(state, "index/")
        name, kind = self.key, self.kind
        if not paths:
            return self.spark.createDataFrame([], f"file string, `{name}` {kind}")
        index = self.spark.read.schema(self._index_schema()).parquet(*paths).where(F.col("file").isin(*[n for n in state.live if n.startswith("data/")]))

        def probe(own: pa.Table, files: pa.Table) -> pa.Table:
            out_files, out_keys = [], []
            h1, h2 = (own[c].to_numpy() for c in ("_h1", "_h2"))
            values = own[name].combine_chunks()
            for row in files.select(["file", "low", "high", "bloom"]).to_pylist():
                inside = pc.and_(pc.greater_equal(values, row["low"]), pc.less_equal(values, row["high"]))
                at = np.flatnonzero(inside.to_numpy(zero_copy_only=False))
                at = at[may_hold(row["bloom"], h1[at], h2[at])]
                out_files += [row["file"]] * len(at)
                out_keys.append(values.take(pa.array(at)))
            found = pa.chunked_array(out_keys, values.type)
            return pa.table([pa.array(out_files, pa.string()), found], ["file", name])

        return keys.groupBy("_bucket").cogroup(index.groupBy("_bucket")).applyInArrow(probe, f"file string, `{name}` {kind}")

    def load(self, batch: DataFrame, writer: str, batch_id: int) -> int | None:
        """Add the rows whose key the table lacks; how many, or None if this writer has committed this load or a later one."""
        state = self.log.state()
        if state.committed(writer, batch_id):
            return None
        if "buckets" in state.meta:
            self.buckets = int(state.meta["buckets"])
        with scratch_scope(self.spark):
            given = batch.select(*self.schema.names).where(F.col(self.key).isNotNull())
            rest = [f.name for f in self.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
            once = given.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), F.struct(*rest)).alias("_row"))
            rows = stage(self._hashed(once.select("_row.*")), "given")
            while True:
                suspects = stage(self._suspects(rows.select(self.key, "_h1", "_h2", "_bucket"), state), "suspects")
                files = [r[0] for r in suspects.select("file").distinct().collect()]
                self.files_read = len(files), len(self._paths(state, "data/"))
                held = self._read([f"{self.target}/{f}" for f in files]).select(self.key)
                # Only what a filter let through is looked up.
                known = suspects.select(self.key).distinct().join(held, self.key, "left_semi")
                new = stage(rows.join(known, self.key, "left_anti").select(*self.schema.names), "new")
                names, index = self._write(new)
                added = dict.fromkeys([*names, index]) if names else {}
                if self.log.commit(state, added, writer=writer, batch_id=batch_id, meta={"buckets": str(self.buckets)}):
                    return new.count()
                # Another load was first; its keys are known now.
                state = self.log.state()
                if state.committed(writer, batch_id):
                    return None
                self.buckets = int(state.meta["buckets"])

    def squash(self, most: int = 16) -> int:
        """Rewrite the buckets that have more than ``most`` files as one file each; returns how many files went. Gives up if a load is committed meanwhile."""
        state = self.log.state()
        by_bucket: dict[str, list[str]] = {}
        for name in state.live:
            if name.startswith("data/"):
                by_bucket.setdefault(name.rpartition("=")[2], []).append(name)
        old = [n for names in by_bucket.values() if len(names) > most for n in names]
        if not old:
            return 0
        self.buckets = int(state.meta["buckets"])
        with scratch_scope(self.spark):
            names, index = self._write(self._read([f"{self.target}/{n}" for n in old]))
        return len(old) if self.log.commit(state, dict.fromkeys([*names, index]), drop=old, unused=old) else 0
