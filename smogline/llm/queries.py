"""The registered queries of the training-data operators and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from smogline.llm import bpe, decontam, langid, license, linededup, mainhtml, prefixtrie, quality, sharding, simhash, spelling, tokenbin, toxicity
from smogline.session import tune


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")      # whole texts: keep batches small
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontam.leaked_items(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return bpe.encode_documents(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False)


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases of every document."""
    return license.scan_licenses(_read(spark, folder, "documents")).drop("spans")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(_read(spark, folder, "documents"), langid.load_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, fixed rule and learned decision list for every document."""
    return quality.judge_quality(_read(spark, folder, "documents"), _read(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place and checksum of every document's ids in the binary files."""
    docs, files = _read(spark, folder, "documents"), tokenbin.token_folder(spark)
    parts = tokenbin.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, files)
    return tokenbin.read_tokens(parts, files)


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of eight contiguous shards of near equal bytes; equal texts stay together."""
    return sharding.shard_documents(_read(spark, folder, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_read(spark, folder, "documents"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return mainhtml.extract_pages(_read(spark, folder, "pages"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its repeated lines cut out and the cut spans."""
    out = linededup.dedup_lines(_read(spark, folder, "documents"))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), "removed")


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    ranked = prefixtrie.numbered_turns(_read(spark, folder, "conversations"))
    return prefixtrie.prefix_trie(*prefixtrie.rebuilt(ranked))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score, verdict and nearest labelled examples of every document."""
    return toxicity.judge_toxicity(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    return spelling.spelling_variants(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_byte_bpe, op3_license_scan, op4_language_id, op5_quality_rules, op6_token_files, op7_sharding,
    op8_simhash_near_dedup, op9_html_extraction, op10_substring_dedup,
    op11_conversation_trie, op12_toxicity, op13_spelling_variants)}

ORACLE_SQL = {"op3_license_scan": license.check_sql(), "op11_conversation_trie": prefixtrie.check_sql(),
              "op13_spelling_variants": spelling.check_sql()}
