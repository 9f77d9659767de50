"""From raw documents to token ids: quality rules, near-dedup, line dedup, decontamination, byte-level BPE.

Every stage takes (spark, docs, folder of the other tables) and returns a table that is written and read again as the next
one's input.  All but the last return the columns of documents.  Intermediate tables of a stage are deleted when the
next one starts, because by then its output stands.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from smogline.llm import bpe, common, decontam, linededup, quality, simhash
from smogline.session import tune

RANKS = "byte_bpe_multi_50k.tiktoken"
_pending: list[str] = []        # intermediate tables of the stage whose output is being written


def _stage(work):
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        common.remove(spark, _pending)
        with common.scratch() as made:
            out = work(spark, docs, folder)
        _pending[:] = made
        return out
    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that the fixed rule or the learned decision list rejects."""
    return quality.filter_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return simhash.keep_one_per_group(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cuts repeated lines; n_chars follows the text."""
    return linededup.dedup_lines(docs).select(*[F.coalesce(F.length("text").cast("long"), F.lit(0)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The ids of every document with its key and source, and digests of ids and decoded bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), keep=("doc_id", "lang", "source"), lasting=False)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup),
          ("benchmark decontamination", decontamination), ("byte-level BPE", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; each one's output is written to the shared folder first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: The learned rules and the component search are no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None
