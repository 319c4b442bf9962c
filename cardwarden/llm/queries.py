"""The text operators as registered queries, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    contamination, conversation_trie, language, line_dedup, merkle, oracle, pages, sentence_pieces, sharding, simhash, substrings, token_counts, token_files,
    weighted_sampling,
)
from .common import table
from ..session import stage


#: Tokenizer files; their place is the same on every machine.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = token_files.round_trip(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.where(~language.held_out()))
    found = language.identify(documents, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_rows(table(spark, sf_dir, "documents"))


def encoded_and_decoded(documents: DataFrame) -> DataFrame:
    """Ids of each text, digested, and whether decoding them gives the text back."""
    text = F.coalesce("text", F.lit(""))
    # The library too reads a literal U+2581 as a space.
    plain = F.replace(text, F.lit(sentence_pieces.SPACE), F.lit(" "))
    rows = documents.select("doc_id", "text", F.length(text).cast("long").alias("n_chars"), F.sha2(plain, 256).alias("want"))
    # One pass, as a second Python worker beside each task would keep as many words.
    found = sentence_pieces.encode(rows, PIECE_MODEL, decoded="decoded")
    digest = F.sha2("decoded", 256)
    return found.select(
        "doc_id", "n_chars", F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        digest.alias("decoded_sha256"), (digest == F.col("want")).alias("round_trip"),
    )


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def branched(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first of its twenty, as ``conversation_trie.trie`` reads them; stored."""
    leader = F.col("conv_id").cast("long") - F.col("conv_id").cast("long") % 20
    rows = conversation_trie.sequences(conversations, leader)
    taken = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    head = F.first(F.when(F.col("conv") == F.col("group"), F.slice("turns", 1, 3)), ignorenulls=True).over(Window.partitionBy("group"))
    rows = rows.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).withColumn("h", taken)
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return stage(rows.select("conv", turns.alias("turns")).select(*conversation_trie.as_paths(F.col("conv"), F.col("turns"))), "rebuilt")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(branched(table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def merkle_rows(documents: DataFrame) -> DataFrame:
    """Each row's proof under the root of all, digested, and whether the row, in some cases with a changed text, still leads to that root."""
    fields = [F.col(c) for c in merkle.FIELDS]
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    digest, other = merkle.leaf_digest(fields), merkle.leaf_digest([*fields[:-1], changed])
    leaves = documents.select(
        merkle.tree_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), digest.alias("digest"),
        F.when(tampered, other).otherwise(digest).alias("seen"),
    )
    found = merkle.manifest(leaves, ["id", "digest"], ["id", "seen"])
    hexed = lambda c: F.lower(F.hex(c))
    found = found.select(
        F.col("id").alias("doc_id"), hexed("digest").alias("leaf"), hexed("top").alias("subroot"), hexed("root").alias("root"),
        merkle.proof_digest().alias("proof_sha256"), merkle.folded(hexed("seen")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_token_files, op3_sharding, op4_substrings, op5_simhash, op6_pages,
        op7_language, op8_contamination, op9_fingerprints, op10_sentence_pieces,
        op11_conversation_trie, op12_line_dedup, op13_merkle,
    )
}
ORACLE = {
    "op4_substrings": oracle.SUBSTRINGS, "op8_contamination": oracle.CONTAMINATION, "op11_conversation_trie": oracle.CONVERSATIONS,
    "op12_line_dedup": oracle.LINES, "op13_merkle": oracle.MERKLE,
}
