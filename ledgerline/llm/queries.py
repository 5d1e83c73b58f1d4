"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import licenses, linededup, media, packing, periods, pieces, quality, resampling, simhash, suffixes, syncmers, urls, warc
from ledgerline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed", "removed_words", "first_docs")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_digests(spark)).select("doc_id", "license_digest", "license")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.code_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_total", "lines_dropped")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_documents(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", media.media_facts("media").alias("m")).select("doc_id", "n_bytes", "m.*")


#: The rules of op10 (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of labelled pages: the number in a path after the language names the document whose label a page has."""
    place = urls.path_of(F.col("url"))
    number = F.expr("try_cast(number AS bigint)")
    named = pages.select(urls.host_of(F.col("url")).alias("host"), F.regexp_extract(place, "^/[a-z]+/([0-9]+)", 1).alias("number")).select("host", number.alias("doc_id"))
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    return named.where("doc_id is not null").join(known, "doc_id").select("host", "good")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, rules = table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "labels"))
    judged = urls.judge_urls(pages.select("page_id", "url"), rules, outcomes, **urls.OP10)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("share", 6).alias("share"), F.round("upper", 6).alias("upper"), "labelled")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_suffix_array": op2_suffix_array,
        "op3_licenses": op3_licenses,
        "op4_simhash": op4_simhash,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_fingerprints": op8_fingerprints,
        "op9_media": op9_media,
        "op10_urls": op10_urls,
        "op11_warc": op11_warc,
        "op12_periods": op12_periods,
        "op13_resampling": op13_resampling,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_licenses": licenses.ORACLE_SQL,
        "op6_line_dedup": linededup.ORACLE_SQL,
        "op10_urls": urls.ORACLE_SQL,
        "op11_warc": warc.ORACLE_SQL,
        "op13_resampling": resampling.ORACLE_SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
