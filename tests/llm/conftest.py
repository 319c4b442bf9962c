import hashlib
import zlib

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Extra columns whose names the operators use inside.
CLASHING = ["id", "row", "shard", "slot", "fingerprint", "n_words", "score", "part", "key", "items", "hit", "u", "v"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table, extra columns with clashing names included, from (id, text[, lang])."""

    def build(rows):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])

    return build


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def crc(text):
    return zlib.crc32((text or "").encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
