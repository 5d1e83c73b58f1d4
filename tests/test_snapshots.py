"""Nested snapshots, digests, recorded results and trails."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import graph, memo, snapshots, structure

STORIES = "owner int, section string, sort_order int, entity int, story int, name string, subtitle string, dates string"
COMPONENTS = "story int, kind string, place int, component_id string, text string, claim_ids array<int>, outcome_quote string, evidence_text string, attested boolean"
ROWS = [(1, "projects_hackathons", 1, 5, 50, "b", None, ""), (1, "projects_hackathons", 0, 6, 60, "a", "s", "d"), (1, "elsewhere", 0, 7, 70, "c", None, ""), (2, "professional_experience", 0, 8, 80, "d", None, "")]
PARTS = [
    (50, "problem", 0, "p", "P", [1], None, "e", False), (50, "action", 1, "a2", "second", [2], None, None, False), (50, "action", 0, "a1", "first!", [1, 2], None, "ea", False), (50, "result", 0, "r", "R", [], "q", "er", True),
    (60, "action", 0, "a", "alone", [3], None, "", False), (70, "action", 0, "x", "lost", [4], None, "", False), (80, "result", 0, "r", "no action", [4], None, "", False),
]


def both(spark, stories=ROWS, parts=PARTS):
    return spark.createDataFrame(stories, STORIES), spark.createDataFrame(parts, COMPONENTS)


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=str)


def test_flattening_gives_back_what_was_assembled(spark):
    stories, parts = both(spark)
    made = snapshots.assemble(stories, parts)
    assert rows(snapshots.stories_of(made)) == rows(stories.where("section <> 'elsewhere'"))
    assert rows(snapshots.components_of(made)) == rows(parts.where("story <> 70"))
    one = {r["owner"]: r["sections"] for r in made.collect()}[1]
    assert [s["section"] for s in one] == snapshots.SECTIONS and one[0]["entries"] == [] and [e["story"] for e in one[1]["entries"]] == [60, 50]
    assert [b["text"] for b in one[1]["entries"][1]["bullets"]] == ["first!", "second.", "R."]


def test_digests_ignore_order_and_see_every_change(spark):
    of = lambda stories, parts: {r["owner"]: r["digest"] for r in snapshots.with_digest(snapshots.assemble(*both(spark, stories, parts))).collect()}
    base = of(ROWS, PARTS)
    assert of(ROWS[::-1], PARTS[::-1]) == base
    for k, new in ((2, 9), (3, "A2"), (4, "other"), (5, [7]), (7, "ev"), (8, True)):
        changed = of(ROWS, [PARTS[0], tuple(new if i == k else v for i, v in enumerate(PARTS[1])), *PARTS[2:]])
        assert changed[1] != base[1] and changed[2] == base[2]


def test_canonical_values(spark):
    row = spark.sql("select named_struct('b', map('y', 1, 'x', 2), 'a', array(named_struct('d', null, 'c', 'q\"')), 'e', cast(null as struct<z: int>)) as v")
    assert row.select(snapshots.canonical(F.col("v"), row.schema["v"].dataType)).first()[0] == '{"a":[{"c":"q\\"","d":null}],"b":[{"key":"x","value":2},{"key":"y","value":1}],"e":null}'


def test_claims_pair_results_with_the_first_action(spark):
    got = snapshots.claims_of(snapshots.assemble(*both(spark))).orderBy("source_ref").collect()
    assert [(r["action"], r["problem"], r["result"], r["source_ref"], r["evidence_text"]) for r in got] == [
        ("first!", "P", None, "story:50:a1", "ea"), ("second", "P", None, "story:50:a2", ""), ("first!", "P", "R", "story:50:r", "ea\ner"), ("alone", None, None, "story:60:a", ""),
    ]


def test_sets_have_one_fingerprint(spark):
    of = lambda t, v="": spark.createDataFrame([(t,)], "t array<string>").select(snapshots.set_fingerprint(F.col("t"), v)).first()[0]
    assert of(["A  b", "c"]) == of(["c", " a B", "C", " "]) != of(["a b"]) and of(["a"], "1") != of(["a"], "2")


INPUTS = "fingerprint string, text string"


def sized(missing):
    return missing.select("fingerprint", F.length("text").alias("n"))


def test_a_second_run_computes_nothing_and_a_new_version_all(spark, tmp_path):
    inputs = spark.createDataFrame([("a", "x"), ("b", "xx"), ("b", "xx")], INPUTS)
    store = lambda v: memo.Memo(spark, str(tmp_path), "n int", v)
    first, n = store("1").get(inputs, sized)
    assert n == 2 and rows(first) == [("a", 1), ("b", 2)]
    again, n = store("1").get(inputs, lambda missing: pytest.fail("computed again"))
    assert n == 0 and rows(again) == rows(first)
    more, n = store("1").get(inputs.union(spark.createDataFrame([("c", "xxx")], INPUTS)), sized)
    assert n == 1 and rows(more) == [("a", 1), ("b", 2), ("c", 3)]
    other, n = store("2").get(inputs, lambda m: m.select("fingerprint", F.lit(9).alias("n")))
    assert n == 2 and rows(other) == [("a", 9), ("b", 9)] and rows(store("1").recorded()) == [("a", 1), ("b", 2), ("c", 3)]


def test_runs_at_the_same_time_agree(spark, tmp_path):
    """Each computes other values; whoever takes the first turn counts for both."""
    inputs, gate, got = spark.createDataFrame([("a", "x"), ("b", "xx")], INPUTS), threading.Barrier(3), {}

    def run(k):
        def compute(missing):
            gate.wait(60)
            return missing.select("fingerprint", F.lit(k).alias("n"))

        found, n = memo.Memo(spark, str(tmp_path), "n int", "1").get(inputs, compute)
        got[k] = n, rows(found)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    final = rows(memo.Memo(spark, str(tmp_path), "n int", "1").recorded())
    assert {n for n, _ in got.values()} == {2} and len({r[1] for r in final}) == 1 and len(memo.Memo(spark, str(tmp_path), "n int", "1").turns()) == 3
    winner = final[0][1]
    assert got[winner][1] == final  # the first turn is never replaced


def test_a_run_that_died_on_its_turn_is_passed_over(spark, tmp_path):
    (tmp_path / "turns").mkdir()
    (tmp_path / "turns" / "0").touch()
    store = memo.Memo(spark, str(tmp_path), "n int", "1", patience=0.2)
    found, n = store.get(spark.createDataFrame([("a", "x")], INPUTS), sized)
    assert n == 1 and rows(found) == [("a", 1)] and list(store.turns()) == [1]


def test_trails_of_deep_trees(spark):
    chain = [(i, i - 1 if i else None, f"h{i}") for i in range(70)] + [(100, 999, "orphan"), (101, 100, "child")]
    got = {r["node"]: (r["root"], r["depth"], r["trail"]) for r in graph.trails(spark.createDataFrame(chain, "n int, p int, l string"), "n", "p", "l").collect()}
    assert got == {i: (0, i, [f"h{k}" for k in range(i + 1)]) for i in range(70)} | {100: (100, 0, ["orphan"]), 101: (100, 1, ["orphan", "child"])}
    with pytest.raises(RuntimeError):
        graph.trails(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "n int, p int, l string"), "n", "p", "l", max_depth=64)


def test_heading_trails(spark):
    docs = spark.createDataFrame([(1, "intro here\n# A\ntext one\n### C\n- item\n## B #\nmore"), (2, ""), (3, None)], "id int, text string")
    got = structure.heading_trails(structure.elements(docs, "id"), "id").orderBy("seq").collect()
    assert [(r["kind"], r["trail"]) for r in got] == [("paragraph", None), ("heading", "A"), ("paragraph", "A"), ("heading", "A > C"), ("item", "A > C"), ("heading", "A > B #"), ("paragraph", "A > B #")]


def test_commits_are_one_element(spark):
    got = structure.commit_elements(spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None)], "id int, text string"), "id").collect()
    assert [tuple(r) for r in got] == [(1, 0, "commit_message", 0, 4, None, None, "a\n\nb")]
