"""Lines that many documents hold, dropped from all of them but one.

Every line becomes a key: the line without white space at its ends, A-Z in lower case. Keys are hashed, documents are counted for each hash, and a line
goes where its hash has enough documents, this one not the last of them by id. What is left of a text is put together again in the order of its lines.

The hash has 128 bits (BLAKE2b). A hash travels with the id of its document and never with its line. Counting takes two steps, one row for each hash and
document and then one for each hash, with a partial sum in every task, so a line of a third of all documents is one row from each task. Texts move at most
once, next to the hashes they lose, and not at all if these are few enough to send everywhere.

Defined cases: NULL and empty texts are one empty line; short keys never go, however often they occur; a document counts once for a line it
repeats, and so do rows that share an id; rows without id are no documents to count, and lose nothing; repeated rows are repeated; an empty table gives no rows.
Extra columns are ignored. A text is one row of a batch and is split whole: a task needs about five times the bytes of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACES, arrow_map, row_key, slices

#: Code points of a key that may go, and documents that must hold it.
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3


def line_hashes(lines: list[bytes], least: int = LEAST_CHARS) -> list[bytes | None]:
    """The hash of each line's key; None where the key is too short to go."""
    found: list[bytes | None] = []
    for line in lines:
        # Of bytes, only A-Z have a lower case.
        key = line.strip(SPACES).lower()
        long = len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least)
        found.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return found


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def document_lines(df: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``id``, ``key`` and the distinct ``line`` hashes of every row that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [list({*line_hashes(_lines(t), least)} - {None}) for t in part.column("text").to_pylist()]
            lists = pa.array(found, pa.list_(pa.binary()))
            at = pc.list_parent_indices(lists)
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("key").take(at), lists.flatten()], ["id", "key", "line"])

    kind = df.schema["id"].dataType.simpleString()
    return arrow_map(df.where(F.col("id").isNotNull()).select("id", "key", "text"), run, f"id {kind}, key long, line binary")


def drop_lines(
    df: DataFrame, id_: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``id_``, ``n_lines`` before, ``n_dropped`` and the text ``kept`` of every row."""
    documents = df.select(F.col(id_).alias("id"), row_key(id_, text).alias("key"), F.col(text).alias("text"))
    lines = stage(document_lines(documents, least_chars), "lines")
    holders = lines.select("line", "id").distinct().groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    common = stage(holders.where(F.col("n") >= least_documents).select("line", "last"), "common")
    lost = lines.join(common, "line").where(F.col("id") < F.col("last"))
    # Rows of one id and text lose the same lines, so their list is as long as one text at most.
    gone = stage(lost.groupBy("id", "key").agg(F.collect_set("line").alias("gone")), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            before, dropped, kept = [], [], []
            for own, out in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                if not out:
                    before.append((own or "").count("\n") + 1)
                    dropped.append(0)
                    kept.append(own or "")
                    continue
                all_, out = _lines(own), set(out)
                left = [line for line, hash_ in zip(all_, line_hashes(all_, least_chars), strict=True) if hash_ not in out]
                before.append(len(all_))
                dropped.append(len(all_) - len(left))
                kept.append(b"\n".join(left).decode())
            made = [pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", "n_lines", "n_dropped", "kept"])

    kind = df.schema[id_].dataType.simpleString()
    together = documents.join(gone, ["id", "key"], "left").select("id", "text", "gone")
    return arrow_map(together, run, f"id {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("id", id_)
