"""From documents to packed training sequences in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import linededup, packing, quality, simhash, suffixes
from ledgerline.llm.common import dropped_after, materialize, table


def _shortened(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    counted = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return counted.select(*(F.col(f"`{c}`") for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line equals or nearly equals."""
    return _shortened(linededup.line_dedup(docs), docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.near_dedup(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that occurred earlier."""
    return _shortened(suffixes.remove_repeats(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("suffix_array", suffix_stage), ("packing", packing_stage)]

#: Learnt scores, fingerprints, suffixes and packings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, written as Parquet in between; a stage's own tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with dropped_after(spark) as tables:
            docs = materialize(stage(spark, docs, sf_dir))
            tables.pop()  # the stage's result, written last
    return STAGES[-1][1](spark, docs, sf_dir)
