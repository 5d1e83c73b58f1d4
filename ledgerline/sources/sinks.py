"""Writers that can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` in place of the partitions they have; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append (kind, subject_ref, passed, detail, at)."""
    rows.select("kind", "subject_ref", "passed", "detail", "at").write.mode("append").parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def sendable(drafts: DataFrame) -> DataFrame:
    """``drafts`` with outcome: sent for approved ones with an address, skipped for others that are approved, null for the rest."""
    has = F.coalesce(F.trim("email"), F.lit("")) != ""
    return drafts.withColumn("outcome", F.when(F.col("status") != "approved", F.lit(None)).when(has, "sent").otherwise("skipped"))


def write_keyed(rows: DataFrame, path: str, key: list[str], files: int | None = None) -> None:
    """Parquet whose files hold ranges of the key, in order, with Bloom filters on its columns: reads by key, or by a prefix of it, skip files and row groups."""
    ranged = rows.repartitionByRange(files, *key) if files else rows.repartitionByRange(*key)
    writer = ranged.sortWithinPartitions(*key).write.mode("overwrite")
    for column in key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
