"""The manifest, the ledger and the audits: one corrupted row a check fails exactly that check."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audits, ledger


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_manifest_and_required_names(spark):
    docs = spark.createDataFrame(
        [(1, "drive", "notes.txt", "My Ship-It notes", "about Snow_Flake", None, "ok"), (2, "github_commit", "me/repo@abc@d", None, "nothing", "h", None), (3, "github", "me/repo", "T", None, None, None), (4, "drive", "p", "Ship", "It here", None, None)],
        "source_id int, system string, path string, title string, raw string, content_hash string, status string",
    )
    projects = spark.createDataFrame([("Ship-It", ["shipper"]), ("Repo", [])], "name string, aliases array<string>")
    required = spark.createDataFrame([("snow flake",), ("SHIP IT",), ("absent",)], "name string")
    entries = ledger.manifest(docs, projects, required)
    got = {r["source_id"]: (r["name"], r["size_bytes"], r["repository"], r["commit_sha"], r["extraction_status"], r["project_references"]) for r in entries.collect()}
    assert got == {
        1: ("My Ship-It notes", 16, None, None, "ok", ["Ship-It", "snow flake"]), 2: ("me/repo@abc@d", 7, "me/repo", "abc@d", "captured", ["Repo"]), 3: ("T", None, "me/repo", None, "uncaptured", ["Repo"]), 4: ("Ship", 7, None, None, "captured", []),
    }
    assert {r["name"]: r["present"] for r in ledger.required_present(entries, required).collect()} == {"snow flake": True, "SHIP IT": True, "absent": False}


def test_every_fault_of_an_object(spark):
    objects = spark.createDataFrame(
        [(1, "a b", sha("a b"), None, "x"), (2, None, None, None, None), (3, "a", "bad", "ok", "x"), (4, "a", sha("a"), "failed", None), (5, "a", sha("a"), None, "x"), (6, "a", sha("a"), None, "x"), (7, "  ", sha("  "), None, "x")],
        "source_id int, raw string, content_hash string, status string, location string",
    )
    faults = spark.createDataFrame([(5, k, "gap") for k in range(8)] + [(2, 0, "gap")], "source_id int, start int, reason string")
    trees = spark.createDataFrame([(k, 2, f"h{k}") for k in (1, 3, 4, 5)], "source_id int, elements int, output_hash string")
    rows = ledger.reconciled(objects, faults, trees)
    got = {r["source_id"]: (r["failures"], r["structure_complete"], r["output_hash"], r["status"]) for r in rows.collect()}
    assert got == {
        1: ([], True, "h1", "ok"), 2: (["no_capture"], False, None, "failed"), 3: (["hash_mismatch"], True, "h3", "failed"), 4: (["extraction_failed", "no_provenance"], True, "h4", "failed"),
        5: (["structure:gap"] * 5, False, None, "failed"), 6: (["no_elements"], False, None, "failed"), 7: ([], True, None, "ok"),
    }
    total = ledger.rollup(rows).first()
    assert (total["objects"], total["failed"], total["raw_captured_pct"], total["structure_complete_pct"], total["passed"]) == (7, 5, 85.714, 57.143, False)
    assert ledger.rollup(rows.limit(0)).first()["passed"] is True


@pytest.mark.parametrize(
    ("text", "start", "end", "ok"),
    [("one two", 0, 7, True), ("one two", 0, 8, True), ("two three", 4, 13, True), ("three", None, None, True), ("four", None, None, False), (" ", None, None, False), ("one two", 0, 99, False), ("one", 4, 7, False)],
)
def test_recomputing(spark, text, start, end, ok):
    rows = spark.createDataFrame([(text, start, end, "one two\nthree")], "text string, start int, end int, raw string")
    assert ledger.recomputable(rows).first()["recomputes"] is ok


def failed(check):
    r = check.first()
    return r["checked"], r["failed"], r["examples"]


def test_audits_of_coverage_and_orphans(spark):
    docs, faults = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2, 0, "gap"), (2, 5, "gap")], "id int, start int, reason string")
    assert failed(audits.element_coverage(docs, faults)) == (2, 1, "2") and failed(audits.element_coverage(docs, faults.limit(0))) == (2, 0, "")
    evidence = spark.createDataFrame([(1, 10, 100, True), (2, 10, 101, True), (3, 10, 999, True), (4, 10, None, False), (5, None, None, False), (6, 10, None, True)], "id int, version int, element int, recomputes boolean")
    elements = spark.createDataFrame([(100, 10), (101, 11)], "element int, version int")
    assert failed(audits.active_orphans(evidence, elements)) == (6, 3, "2,3,4")


STORY = {
    "stories": [(1, "e")], "components": [(1, "problem", "p", [1], None), (1, "action", "a", [1], None), (1, "result", "r", [2], "5 percent")],
    "claims": [(1, "e"), (2, "e"), (3, "f")], "links": [(1, 10, "action"), (2, 11, "result")], "evidence": [(10, "x"), (11, "cut by 5  percent")], "attestations": [(9, "problem")],
}


@pytest.mark.parametrize(
    ("table", "rows", "count"),
    [
        (None, None, 0), ("components", [(1, "action", "b", [3], None)], 1), ("components", [(1, "action", "b", [77], None)], 1), ("links", [(1, 55, "action")], 1), ("components", [(1, "result", "s", [2], "6 percent")], 1),
        ("stories", [(2, "e")], 1), ("attestations", [(1, "result")], 0),
    ],
)
def test_the_walk_fails_for_each_break(spark, table, rows, count):
    schemas = {
        "stories": "story int, entity string", "components": "story int, kind string, component_id string, claim_ids array<int>, outcome_quote string", "claims": "id int, entity string", "links": "claim int, evidence int, field string",
        "evidence": "id int, text string", "attestations": "story int, kind string",
    }
    frames = {n: spark.createDataFrame(STORY[n] + (rows if n == table else []), schemas[n]) for n in STORY}
    assert failed(audits.provenance_walk(**frames))[1] == count
