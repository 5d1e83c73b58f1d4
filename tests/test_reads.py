"""Reads by filters and keys, orders, and conversions of values."""

import json
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import reads
from ledgerline.sources import sinks

EVIDENCE = "id int, entity string, element int, seq int, active boolean, source_type string, source_ref string"


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(spark):
    rows = [(1, None, None, None, True, "drive", "a"), (2, None, 5, 1, False, "drive", "b"), (3, None, 5, 1, True, "user_attestation", "c"), (4, "e", 5, 1, True, "drive", "d"), (5, "e", None, None, False, "drive", "e")]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    elements = spark.createDataFrame([(5,), (5,), (9,)], "element int")
    assert ids(reads.unassigned(evidence)) == [1] and ids(reads.assigned(evidence, "e")) == [4]
    assert ids(reads.of_elements(evidence, elements)) == [3, 4] and ids(reads.of_elements(evidence, elements.limit(0))) == []
    stories = spark.createDataFrame([(1, "draft"), (2, "approved")], "id int, status string")
    assert ids(reads.with_status(stories)) == [1, 2] and ids(reads.with_status(stories, "approved")) == [2]
    claims, entities = spark.createDataFrame([(1, "e"), (2, "f"), (3, None)], "id int, entity string"), spark.createDataFrame([("e", "confirmed"), ("f", "proposed")], "entity string, status string")
    assert ids(reads.of_confirmed(claims, entities)) == [1]


def test_document_order_and_minted_numbers(spark):
    rows = [(4, "e", None, None, True, "x", ""), (3, "e", None, 0, True, "x", ""), (2, "e", 7, 1, True, "x", ""), (1, "e", 7, 2, True, "x", ""), (5, "e", 6, 9, True, "x", ""), (6, "f", 7, 0, True, "x", "")]
    got = reads.minted(spark.createDataFrame(rows, EVIDENCE), reads.document_order(), "n", start=10, group=["entity"]).orderBy("n", "entity").collect()
    assert [(r["id"], r["n"]) for r in got] == [(5, 11), (6, 11), (2, 12), (1, 13), (4, 14), (3, 15)]


def test_numbers_over_all_rows(spark):
    got = reads.minted(spark.range(500).repartition(3), [F.col("id").desc()], "n", start=7).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, 507 - i) for i in range(500)]


def test_applications_with_at_most_one_outreach(spark):
    rows, jobs = spark.createDataFrame([(1, 10), (2, 99)], "application int, job int"), spark.createDataFrame([(10, "t", "u")], "job int, title string, url string")
    outreach = spark.createDataFrame([(1, 2, "late", "sent"), (1, 1, "first", "drafted")], "application int, id int, recipient string, state string")
    got = {r["application"]: (r["title"], r["recipient"], r["outreach_state"]) for r in reads.applications(rows, jobs, outreach).collect()}
    assert got == {1: ("t", "first", "drafted"), 2: (None, None, None)}


@pytest.mark.parametrize(
    ("kind", "ref", "url"),
    [
        ("github_readme", "me/r", "https://github.com/me/r"), ("github_commit", "me/r@abc", "https://github.com/me/r/commit/abc"), ("github_commit", "a@b@c", "https://github.com/a@b/commit/c"), ("github_commit", "me/r", None), ("github_commit", "@abc", None),
        ("github_pr", "me/r#12", "https://github.com/me/r/pull/12"), ("github_pr", "me/r#x", None), ("drive", " id1#chars=0-9 ", "https://drive.google.com/open?id=id1"), ("upload", "f", None), ("drive", " ", None),
    ],
)
def test_where_evidence_is_read(spark, kind, ref, url):
    assert spark.createDataFrame([(kind, ref)], "k string, r string").select(reads.evidence_url(F.col("k"), F.col("r"))).first()[0] == url


def test_values(spark):
    one = spark.createDataFrame([(1.23456, -3.0, "1700000000123", "x", datetime(2024, 1, 2), 7, 0.125)], "a double, b double, m string, j string, t timestamp, n int, r double")
    got = one.select(
        reads.clamped(F.col("a")), reads.clamped(F.col("b")), reads.clamped(F.lit(0.123456)), reads.clamped(F.lit(None)), F.unix_millis(reads.from_millis(F.col("m"))), reads.from_millis(F.col("j")), reads.look_back(F.col("t"), 72).cast("string"),
        reads.percent_line("flagged", F.col("n"), F.col("r")),
    ).first()
    assert tuple(got) == (1.0, 0.0, 0.1235, None, 1700000000123, None, "2023-12-30 00:00:00", f"flagged=7 ({0.125:.0%})")


def test_materials_come_back(spark):
    stored = {"summary": "s", "highlights": ["a", "b"], "cover_letter": "c", "highlight_claim_ids": [1, 2], "highlight_refs": ["r"]}
    rows = [(json.dumps(stored),), ("{}",), ("nope",), ('{"highlights": null, "highlight_claim_ids": [3]}',)]
    got = [r[0].asDict() if r[0] else None for r in spark.createDataFrame(rows, "t string").select(reads.materials_of(F.col("t"))).collect()]
    empty = {"summary": "", "highlights": [], "cover_letter": "", "highlight_claim_ids": [], "highlight_refs": []}
    assert got == [stored, empty, None, empty | {"highlight_claim_ids": [3]}]


def test_reads_by_key_skip_files(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.concat(F.lit("ref-"), F.lpad((F.col("id") * 7919 % 20_000).cast("string"), 5, "0")).alias("ref"))
    sinks.write_keyed(rows, path, ["ref"], files=8)
    groups = [pq.ParquetFile(f).metadata.row_group(0).column(1) for f in Path(path).glob("*.parquet")]
    spans = sorted((g.statistics.min, g.statistics.max) for g in groups)
    assert len(spans) == 8 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    found = spark.read.parquet(path).where("ref = 'ref-01234'")
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 1 and "EqualTo(ref,ref-01234)" in plan
    assert sum(a <= "ref-01234" <= b for a, b in spans) == 1
    prefix = spark.read.parquet(path).where(F.startswith("ref", F.lit("ref-012")))
    assert prefix.count() == 100 and sum(b >= "ref-012" and a < "ref-013" for a, b in spans) <= 2
