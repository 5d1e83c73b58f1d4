"""Plans of changes: folding, guards, and that a second application changes nothing."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes, edits

SCHEMA = "id long, kind string, n int, tags array<string>, status string"


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=str)


def plan_of(spark, *steps):
    """Steps (op, id, columns, yields) in order."""
    return spark.createDataFrame([("t", op, None if i is None else str(i), c, y, k) for k, (op, i, c, y) in enumerate(steps)], changes.CHANGES)


def by_loop(table, steps, parents=None):
    """The same, one change after the other."""
    table, log, began = {r[0]: list(r) for r in table}, [], {r[0] for r in table if r[4] == "done"}
    names = ["id", "kind", "n", "tags", "status"]
    for op, i, columns, yields in steps:
        if i in began and yields:
            log.append("decided")
            continue
        if op == "insert" and i in table:
            log.append("exists")
        elif op == "update" and i not in table:
            log.append("absent")
        elif op in ("insert", "upsert") and i not in table and parents is not None and i not in parents:
            log.append("no_parent")
        else:
            log.append("applied")
            if op == "delete":
                table.pop(i, None)
            else:
                row = table.setdefault(i, [i, None, None, None, None])
                for c, v in columns.items():
                    row[names.index(c)] = int(v) if c in ("n", "id") and v is not None else tuple(v[2:-2].split('","')) if c == "tags" and v else v
    return sorted((tuple(r) for r in table.values()), key=str), log


@pytest.mark.parametrize("seed", range(5))
def test_random_plans_equal_one_change_after_the_other(spark, seed):
    rng = random.Random(seed)
    table = [(i, rng.choice("ab"), rng.randrange(9), ("x", "y"), rng.choice(["open", "open", "done"])) for i in range(12)]
    steps = []
    for _ in range(60):
        i, op = rng.randrange(20), rng.choice(["insert", "update", "upsert", "delete"])
        columns = {c: rng.choice([v, None]) for c, v in (("kind", "new"), ("n", str(rng.randrange(99))), ("tags", '["p","q"]')) if rng.random() < 0.6}
        steps.append((op, i, ({"id": str(i)} if op in ("insert", "upsert") else {}) | columns, rng.random() < 0.7))
    parents = set(range(16))
    target = lambda df: changes.Target(df, ["id"], F.col("status") == "done", spark.createDataFrame([(p,) for p in parents], "id long"))
    plan = plan_of(spark, *steps)
    after, log = changes.apply_changes({"t": target(spark.createDataFrame(table, SCHEMA))}, plan)
    want, told = by_loop(table, steps, parents)
    assert rows(after["t"]) == want
    assert [r["outcome"] for r in log.orderBy("place").collect()] == told


def test_a_plan_of_upserts_and_deletes_twice_is_once(spark):
    table = spark.createDataFrame([(1, "a", 1, ["x"], "open"), (2, "b", 2, None, "done"), (3, "c", 3, [], "open")], SCHEMA)
    target = lambda df: {"t": changes.Target(df, ["id"], F.col("status") == "done")}
    plan = plan_of(spark, ("upsert", 4, {"id": "4", "n": "7"}, True), ("delete", 1, {}, True), ("update", 3, {"tags": '["z"]', "n": None}, True), ("delete", 2, {}, True), ("update", 2, {"n": "5"}, False))
    once, _ = changes.apply_changes(target(table), plan)
    assert rows(once["t"]) == [(2, "b", 5, None, "done"), (3, "c", None, ("z",), "open"), (4, None, 7, None, None)]
    twice, _ = changes.apply_changes(target(once["t"]), plan)
    assert rows(twice["t"]) == rows(once["t"])
    nothing, log = changes.apply_changes(target(table), plan.limit(0))
    assert rows(nothing["t"]) == rows(table) and log.count() == 0


def test_keys_of_several_columns_and_null_keys(spark):
    table = spark.createDataFrame([("a", "b/c", 1), ("a/b", "c", 2), (None, "c", 3)], "x string, y string, n int")
    asked = spark.createDataFrame([("a", "b/c", 10), ("a/b", "c", 20), (None, "c", 30), ("q", '"', 40)], "x string, y string, m int")
    plan = changes.change(asked, "t", "upsert", {"x": F.col("x"), "y": F.col("y")}, {"n": F.col("m")})
    after, log = changes.apply_changes({"t": changes.Target(table, ["x", "y"])}, plan)
    assert rows(after["t"]) == [("a", "b/c", 10), ("a/b", "c", 20), ("q", '"', 40), (None, "c", 3)]
    assert sorted(r["outcome"] for r in log.collect()) == ["applied", "applied", "applied", "no_key"]


def test_several_tables_and_changes_for_none(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y")], "id int, v string")
    plan = plan_of(spark, ("update", 1, {"v": "new"}, True)).unionByName(plan_of(spark, ("update", 1, {"v": "newer"}, True)).withColumn("target", F.lit("u"))).unionByName(plan_of(spark, ("delete", 1, {}, True)).withColumn("target", F.lit("unknown")))
    after, log = changes.apply_changes({"t": changes.Target(a, ["id"]), "u": changes.Target(b, ["id"])}, plan)
    assert rows(after["t"]) == [(1, "new")] and rows(after["u"]) == [(1, "newer")] and log.count() == 2


def test_invalidation_notes_and_packets(spark):
    from datetime import datetime

    stories = spark.createDataFrame([(1, "s", "c", "approved", datetime(2024, 1, 2, 3, 4, 5), None), (1, "t", "c", "draft", None, "old"), (2, "s", "c", "approved", None, None)], "entity int, space string, content string, status string, reviewed_at timestamp, note string")
    plan = edits.invalidations(stories, spark.createDataFrame([(1, "why")], "entity int, reason string"))
    after, _ = changes.apply_changes({"stories": changes.Target(stories, ["entity", "space"], F.col("status").isin(edits.DECIDED))}, plan)
    assert rows(after["stories"].select("entity", "space", "status", "reviewed_at", "note")) == [
        (1, "s", "draft", None, "invalidated: why (previously approved at 2024-01-02T03:04:05)"), (1, "t", "draft", None, "invalidated: why"), (2, "s", "approved", None, None),
    ]
    packets = edits.packet_changes(spark.createDataFrame([(1, "a"), (9, "b")], "interview int, content string"))
    empty = spark.createDataFrame([], "interview int, content string")
    after, log = changes.apply_changes({"packets": changes.Target(empty, ["interview"], parent=spark.createDataFrame([(1,)], "interview int"))}, packets)
    assert rows(after["packets"]) == [(1, "a")] and sorted(r["outcome"] for r in log.collect()) == ["applied", "no_parent"]
