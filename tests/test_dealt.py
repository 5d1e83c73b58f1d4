"""Joins of large tables in parts whose size does not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from ledgerline import plans, tables
from ledgerline.operators import changes, edits
from ledgerline.plans import change_queries, table_queries


def most_rows(df):
    return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    rows = spark.range(5000).selectExpr("id div 5 as k", "id")
    assert tables.dealt(rows, "k").rdd.getNumPartitions() == 50 and tables.dealt(rows.limit(7), "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    both = tables.dealt(rows, "k").join(spark.range(1000).withColumnRenamed("id", "k"), "k")
    assert both.count() == 5000 and most_rows(both) < 300


def test_lines_of_orders_meet_in_small_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    assert most_rows(table_queries._cited(spark, sf_dir)) < 400


def test_changes_meet_their_table_in_small_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    claims, asked = change_queries._claims_and_edits(spark, sf_dir)
    assert most_rows(asked) < 400
    plan = edits.edit_changes(edits.checked_edits(claims, asked)).where("target = 'claims'")
    target = changes.Target(claims, ["id"], F.col("status") != "pending_review")
    after, _ = changes.apply_changes({"claims": target}, plan)
    assert most_rows(changes.outcomes(target, plan)) < 300 and most_rows(after["claims"]) < 300
    assert after["claims"].count() == claims.count()


@pytest.mark.parametrize("name", ["provenance"])
def test_tasks_of_queries_hold_few_rows(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(tables, "ROWS", 100)
    assert most_rows(plans.queries()[name](spark, sf_dir)) < 400
