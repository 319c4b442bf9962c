"""Token counts of whole texts by the compiled tokenizer of ``bpe_transducer``.

A Python worker compiles the tokenizer once and keeps the states it has met for later batches. No row moves: the job is one scan.

Defined cases: NULL counts as empty, with no tokens; strings of special tokens count one each, as
the library has it by default; repeated rows are repeated. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_transducer import Transducer
from .common import arrow_map, slices

LIMIT = 2048


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, path: str, id_: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id_``, ``n_bytes``, ``n_tokens`` and ``over_limit``. ``path`` is the tokenizer's file on every machine."""
    kind = df.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = transducer(path)
        for part in slices(batches, "text"):
            counts = tokenizer.count(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    plain = df.select(F.col(id_).alias("id"), F.col(text).alias("text"), size.alias("n_bytes"))
    made = arrow_map(plain, run, f"id {kind}, n_bytes long, n_tokens long")
    return made.select(F.col("id").alias(id_), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
