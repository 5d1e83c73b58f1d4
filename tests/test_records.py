"""Merges, state machines, graphs, rankings, sources and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import audits, entities, graph, lifecycle, ranking, states
from ledgerline.sources import scan, sinks
from ledgerline.streaming import feeds


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_upsert_is_idempotent_and_keeps_decisions(spark):
    old = spark.createDataFrame([(1, "drafted", "a"), (2, "applied", "b")], "id int, state string, v string")
    new = spark.createDataFrame([(1, "drafted", "x"), (2, "drafted", "y"), (3, "drafted", "z")], "id int, state string, v string")
    keep = F.col("state") != "drafted"
    once = lifecycle.upsert(old, new, ["id"], keep)
    assert rows(once, "id") == [(1, "drafted", "x"), (2, "applied", "b"), (3, "drafted", "z")]
    assert rows(lifecycle.upsert(once, new, ["id"], keep), "id") == rows(once, "id")


def test_partition_replacement_and_absent_rows(spark):
    old, new = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "k string, n int"), spark.createDataFrame([("u", 9)], "k string, n int")
    assert rows(lifecycle.replace_partition(old, new, ["k"]), "k", "n") == [("u", 9), ("v", 3)]
    assert rows(lifecycle.insert_absent(old, spark.createDataFrame([("u", 9), ("w", 4)], "k string, n int"), ["k"]), "k", "n") == [("u", 1), ("u", 2), ("v", 3), ("w", 4)]


def test_supersession_of_pins(spark):
    old = [(1, "d", "same text", True, "p"), (2, "d", "whole old text here", True, "q"), (3, "d", "tiny", True, "r"), (4, "d", "gone", True, "s"), (5, "d", "whole  OLD text", True, "t"), (6, "d", "none", True, None), (7, "d", "old", False, "z")]
    fresh = [(11, "d", "same TEXT", None), (12, "d", "old text", None), (13, "d", "a tiny one more", None)]
    existing = spark.createDataFrame(old, "id int, doc string, body string, is_active boolean, pinned string")
    plan = lifecycle.plan_supersession(existing, spark.createDataFrame(fresh, "id int, doc string, body string, pinned string"))
    got = {r["id"]: (r["successor"], r["match"], r["outcome"]) for r in plan.collect()}
    assert got == {
        1: (11, "exact", "migrated"), 2: (12, "piece", "migrated"), 3: (13, "broader", "warn_broader"), 4: (None, None, "warn_no_successor"), 5: (12, "piece", "warn_conflict"), 6: (None, None, "superseded"),
    }


def test_versions(spark):
    snapshots = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "k string, digest string, version int")
    now = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "x")], "k string, digest string")
    assert rows(lifecycle.next_version(snapshots, now, "k", "digest"), "k") == [("a", "y", 2), ("b", "z", 2), ("c", "x", 1)]
    versions = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True)], "k string, digest string, is_active boolean")
    captured = spark.createDataFrame([("a", "y"), ("c", "q")], "k string, digest string")
    assert rows(lifecycle.capture_versions(versions, captured, "k", "digest"), "k", "digest") == [("a", "x", False), ("a", "y", True), ("b", "x", True), ("c", "q", True)]


def test_state_machines(spark):
    log = spark.createDataFrame([(1, 1, "drafted"), (1, 2, "applied"), (1, 3, "drafted"), (2, 1, "offer"), (2, 2, "offer")], "id int, at int, state string")
    found = states.illegal_steps(log, states.edges(spark, "application"), ["id"], ["at"], "state")
    assert [(r["id"], r["from_state"], r["to_state"]) for r in found.collect()] == [(1, "applied", "drafted")]
    claims = spark.createDataFrame([(1, "pending_review"), (2, "pending_review"), (3, "approved"), (4, "extracted")], "id int, state string")
    asked = spark.createDataFrame([(1, "rejected", 5, " "), (2, "rejected", 5, "why"), (3, "rejected", 5, "why")], "id int, to_state string, at int, note string")
    got = {r["id"]: (r["state"], r["refused"]) for r in states.apply_steps(claims, asked, "id", "claim").collect()}
    assert got == {1: ("pending_review", "note_required"), 2: ("rejected", None), 3: ("approved", "illegal"), 4: ("extracted", None)}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7), (9, 9)], "a int, b int")
    assert rows(graph.connected_components(edges), "node") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    nodes = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 12)] + [(20, 99)], "id int, parent int")
    assert rows(graph.subtrees(nodes, "id", "parent"), "node") == [(i, 1, i - 1) for i in range(1, 12)] + [(20, 20, 0)]


def test_assignment_refuses_ties(spark):
    chunks = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["z"]), (4, [])], "id int, own array<string>")
    profiles = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "entity string, token string")
    assert rows(entities.assign(chunks, profiles, "id", "own"), "id") == [(1, "x", 2), (2, None, 1), (3, None, 0), (4, None, 0)]


def test_similar_pairs_lose_nothing(spark):
    import random

    rng = random.Random(1)
    sets = [(i, sorted(rng.sample("abcdefghij", rng.randint(1, 8)))) for i in range(40)]
    got = {(a, b) for a, b, _ in rows(entities.similar_pairs(spark.createDataFrame(sets, "id int, own array<string>"), "id", "own", 0.5))}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 2 * len(set(x) & set(y)) >= len(set(x) | set(y))}
    assert got == want


def test_ranking_edges(spark):
    posts = spark.createDataFrame([(1, "Kafka", "kafka python"), (2, "", ""), (3, "x", "kafka kafka"), (4, "x", "kafka")], "id int, title string, body string")
    scored = ranking.score_postings(posts, ["kafka", "python"], F.col("title"), F.col("body"))
    assert {r["id"]: r["score"] for r in scored.collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0}
    assert [(r["id"], r["rank"]) for r in ranking.rank(scored, "id", 3).orderBy("rank").collect()] == [(1, 1), (3, 2), (4, 3)]
    assert ranking.score_postings(posts, [], F.col("title"), F.col("body")).where("score <> 0").count() == 0


def test_empty_tables_have_defined_values(spark):
    none = spark.createDataFrame([], "id int, ok boolean")
    assert none.agg(audits.percent(F.col("ok"))).first()[0] == 100.0
    assert none.agg(audits.share(F.count_if("ok"), F.count(F.lit(1)))).first()[0] == 0.0
    found = audits.check("c", none, F.col("ok"), F.col("id")).first()
    assert (found["checked"], found["failed"], found["passes"], found["examples"]) == (0, 0, True, "")


def test_checks_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def fails(k):
        seen.add(1)
        return None if k == 9 else k % 2 == 0

    subject = F.when(F.col("id") != 0, F.concat(F.lit("s"), F.col("id") % 10))
    found = audits.check("c", spark.range(100), fails("id"), subject, 7).first()
    assert (found["checked"], found["failed"], found["passes"], found["examples"]) == (100, 50, False, ",".join(["s0"] * 7))
    assert seen.value == 100


def test_some_token_is_any_of_the_tokens(spark):
    texts = ["", " ", "ab", "the", "The AND", "them", "thee", "the-", "the.", "--the", "--cat", "x+the", "a b c", "of c#1", "+a+", "+ab", "über", "é the cat", "the\nand", "C++", "c.", "..", "for...", "\tfor\tyears1", "the,cat", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r for r in rows.select("text", X.has_token(F.col("text")).alias("a"), (F.size(X.tokens(F.col("text"))) > 0).alias("b")).collect() if r["a"] != r["b"]] == []


def test_metric_conflicts(spark):
    said = ["cutting export failures in half", "Cutting export failures in half across all regions", "cutting export  failures in half", "half of the day", "five cats", "five cats"]
    quotes = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    from ledgerline.functions.text import number_tokens

    got = rows(entities.metric_conflicts(quotes, "id", "text", F.array_join(F.array_sort(number_tokens(F.col("text"))), ",")))
    assert got == [("half", 3, 2)]


# --- sources and sinks -------------------------------------------------------------------


def test_scans(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("hello\nworld")
    (tmp_path / "texts/b.txt").write_text("[Could not read the file]")
    listed = [{"id": "1", "name": "A", "mime_type": "text/plain", "folder_id": "f", "modified_time": "2024-01-01T00:00:00Z", "path": "texts/a.txt"}, {"id": "2", "name": "B", "mime_type": "text/plain", "folder_id": "f", "modified_time": "bad", "path": "texts/b.txt"}, {"id": "3", "name": "C", "mime_type": "image/png", "folder_id": "g", "modified_time": None, "path": "c.png"}]
    (tmp_path / "manifest.json").write_text(json.dumps(listed))
    docs = scan.documents(spark, f"{tmp_path}/manifest.json", f"{tmp_path}/texts")
    why = scan.drive_exclusion(F.col("mime_type"), F.col("folder_id"), ["text/plain"], "f")
    got = {r["id"]: (r["s"], r["w"], r["modified_time"] is None) for r in docs.withColumns({"s": scan.disposition(why, F.col("text")), "w": why}).collect()}
    assert got == {"1": ("ok", None, False), "2": ("read_failed", None, True), "3": ("policy_excluded", "mime_not_allowed:image/png", True)}
    assert {r["title"]: r["mime_type"] for r in scan.uploads(spark, f"{tmp_path}/texts").collect()} == {"a": "text/plain", "b": "text/plain"}


def test_feeds_drop_rows_without_dates(spark, tmp_path):
    posts = [{"source": "s", "external_id": str(i), "title": "t", "company": "c", "posted_at": at} for i, at in enumerate(["2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", None])]
    (tmp_path / "jobs.json").write_text(json.dumps(posts))
    import datetime

    since = datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.UTC)
    assert [r["external_id"] for r in scan.postings(spark, f"{tmp_path}/jobs.json", since).collect()] == ["0"]
    mails = [{"message_id": "1", "subject": "Next ROUND", "sender": "a@b.c", "received_at": "2024-01-01T00:00:00Z", "body": "x"}, {"message_id": "2", "subject": "x", "sender": "a@b.c", "received_at": None, "body": "y"}]
    (tmp_path / "mail.json").write_text(json.dumps(mails))
    assert [r["message_id"] for r in scan.messages(spark, f"{tmp_path}/mail.json", 'interview OR "next round"').collect()] == ["1"]


def test_listing_and_references(spark):
    report = spark.createDataFrame([("- My file (text/plain) [ID: abc]\nnothing here",)], "text string")
    assert rows(scan.listed_lines(report)) == [("My file", "text/plain", "abc")]
    refs = spark.createDataFrame([("a",), ("a#chars=1-2",), ("ab",)], "ref string")
    assert rows(scan.by_reference(refs, "ref", "a"), "ref") == [("a",), ("a#chars=1-2",)]


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), path, ["k"])
    sinks.replace_partitions(spark.createDataFrame([("a", 3)], "k string, n int"), path, ["k"])
    assert {(r["k"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}
    drafts = spark.createDataFrame([("approved", "a@b"), ("approved", " "), ("drafted", "a@b")], "status string, email string")
    assert [r["outcome"] for r in sinks.sendable(drafts).collect()] == ["sent", "skipped", None]


# --- streams -----------------------------------------------------------------------------


@pytest.fixture
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").schema


def test_stream_counts_and_merges(spark, sf_dir, tmp_path, events):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(source))
    stream = feeds.once_each(feeds.feed(spark, str(source), events, "ts", "40 days"), ["event_id"])
    state = {"rows": spark.createDataFrame([], "event_id long, event_type string")}

    def write(merged, number):
        merged.write.mode("overwrite").parquet(f"{tmp_path}/v{number}")
        state["rows"] = spark.read.parquet(f"{tmp_path}/v{number}")

    merge = lambda old, new: lifecycle.upsert(old, new.select("event_id", "event_type"), ["event_id"])
    for _ in range(2):
        feeds.merged_into(stream, lambda: state["rows"], merge, write, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert state["rows"].count() == 1000


def test_stream_of_states(spark, tmp_path):
    schema = "id int, at timestamp, state string"
    spark.createDataFrame([(1, None, "drafted")], "id int, at timestamp, state string").limit(0).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, "drafted"), (1, "offer"), (2, "drafted"), (2, "applied")], "id int, state string").coalesce(1).selectExpr("id", "current_timestamp() at", "state").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = feeds.illegal_steps(stream, "id", "state", "application").writeStream.format("memory").queryName("illegal").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.sql("SELECT * FROM illegal")) == [(1, "drafted", "offer")]


def test_no_legal_step_is_dropped(spark):
    legal = spark.range(12_000).selectExpr("string(id) AS from_state", "string(id + 1) AS to_state")
    log = spark.range(12_001).selectExpr("1 AS id", "id AS at", "string(id) AS state")
    assert states.illegal_steps(log, legal, ["id"], ["at"], "state").count() == 0


def test_subtrees_end_at_their_roots_or_fail(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(66)], "id int, parent int")
    assert rows(graph.subtrees(chain, "id", "parent"), "node") == [(i, 0, i) for i in range(66)]
    with pytest.raises(RuntimeError):
        graph.subtrees(chain, "id", "parent", max_depth=64)
    with pytest.raises(RuntimeError):
        graph.subtrees(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int"), "id", "parent", max_depth=8)


def test_gate_audits(spark):
    evidence = spark.createDataFrame([(1, "text", "a"), (2, "text", "b"), (3, None, "a"), (4, "text", "c")], "id int, source string, ref string")
    versions = spark.createDataFrame([("text", "a", "body"), ("text", "b", "")], "source string, ref string, raw string")
    assert rows(audits.captured(evidence, versions)) == [("capture", 4, 3, False, "2,3,4")]
    owned = spark.createDataFrame([(1, 7, "human"), (2, 7, None), (3, None, None), (4, 8, "")], "id int, entity int, method string")
    assert rows(audits.ownership_labelled(owned)) == [("ownership_labeled", 3, 2, False, "2,4")]
    claims = spark.createDataFrame([(1, "approved"), (2, "rejected"), (3, "approved"), (4, None)], "id int, status string")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 11), (3, 99)], "claim int, evidence int")
    assert rows(audits.reviewed_on_stale(claims, links, spark.createDataFrame([(10, False), (11, True)], "id int, active boolean"))) == [("reviewed_on_stale", 2, 1, False, "1")]
    stamped = spark.createDataFrame([("row", 1, 2), ("row", 2, 1), ("row", 3, None), ("other", 4, 2)], "kind string, id int, version int")
    assert rows(audits.version_consistency(stamped, {"row": 2})) == [("version_consistency", 4, 3, False, "other:4,row:2,row:3")]
    entities_ = spark.createDataFrame([(7, "confirmed"), (8, "confirmed"), (9, "confirmed"), (6, "proposed")], "id int, status string")
    worked = spark.createDataFrame([(7,), (9,), (None,)], "entity int")
    assert rows(audits.entity_coverage(entities_, owned, worked)) == [("entity_coverage", 3, 2, False, "8,9")]
    assert rows(audits.entity_coverage(entities_.limit(0), owned, worked)) == [("entity_coverage", 0, 0, True, "")]


def test_documents_are_those_of_their_own_paths(spark, tmp_path):
    """Equal names in different folders, and names with characters that addresses escape."""
    names = ["a/README.md", "b/README.md", "README.md", "c d/x+y%20z.txt", "c d/ü.txt"]
    for name in names:
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_text(f"text of {name}")
    listed = [{"id": str(i), "name": "n", "path": p} for i, p in enumerate([*names[:-1], "./c d/ü.txt", "missing/README.md"])]
    (tmp_path / "manifest.json").write_text(json.dumps(listed))
    got = scan.documents(spark, str(tmp_path / "manifest.json"), str(tmp_path / "files"))
    assert rows(got.select("id", "text"), "id") == [*((str(i), f"text of {n}") for i, n in enumerate(names)), ("5", None)]


def test_tables_of_one_thread_outlive_the_scope_of_another(spark):
    import threading

    from ledgerline.tables import dropped_after, materialize

    opened, closed, kept = threading.Event(), threading.Event(), {}

    def other():
        with dropped_after(spark):
            opened.set()
            closed.wait(60)
        kept["count"] = kept["table"].count()

    thread = threading.Thread(target=other)
    with dropped_after(spark) as paths:
        thread.start()
        opened.wait(60)
        kept["table"] = materialize(spark.range(3))
        with dropped_after(spark) as inner:
            materialize(spark.range(2))
        assert len(paths) == 1 and len(inner) == 1
        closed.set()
        thread.join(60)
        assert kept["count"] == 3
