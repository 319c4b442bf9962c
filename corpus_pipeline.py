"""A corpus cleaned in stages: language, near copies, repeated passages, test-set leaks, then token ids.

Each stage gets what the one before it kept, with the columns of documents, and returns the same columns; the last returns ids.
A stage with no rows hands on none. Rows without ``doc_id`` are kept by the stages that compare documents, as they compare with nothing.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cardwarden.llm import contamination, language, simhash, substrings  # noqa: E402
from cardwarden.llm.common import row_key, table  # noqa: E402
from cardwarden.llm.queries import encoded_and_decoded  # noqa: E402
from cardwarden.session import stage  # noqa: E402


def _unpack(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters and those below the calibrated score go."""
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model, carry=True)
    return _unpack(found.where(~F.col("rejected")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id, and of several texts under that id one; of repeated rows one.

    Texts that share an id but are no near copies of one another stay. A row is its id and the hash of both, few bytes, so the choice is made before texts move.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", row_key().alias("key")))
    grouped = simhash.near_duplicates(docs.select(row.alias("id"), "text"), "id")
    counted = grouped.where(F.col("id") == F.col("component_id")).groupBy("id.doc_id", "id.key").agg(F.count("*").alias("n"))
    name = "_key"
    while name in docs.columns:
        name += "_"
    chosen = stage(counted.select("doc_id", F.col("key").alias(name), "n"), "chosen")
    keyed = docs.withColumn(name, row_key())
    single = keyed.join(chosen.where("n = 1"), ["doc_id", name], "left_semi")
    once = keyed.join(chosen.where("n > 1"), ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    nameless = keyed.where(F.col("doc_id").isNull())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(columns).unionByName(once.select(columns)).unionByName(nameless.select(columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which nothing is left goes. Untouched texts stay as they are."""
    found = substrings.deduplicate(docs, carry=True)
    cut = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return cut.withColumn("row", F.col("row").withField("text", text).withField("n_chars", F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long")))).select(
        *[F.col(f"row.`{c}`") for c in docs.columns]
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = contamination.scan(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return _unpack(found.where("n_hit = 0"), docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, digested, and whether they decode to its text."""
    return encoded_and_decoded(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("sentence_pieces", sentence_pieces),
]

#: Fingerprints, trained models and merges are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
