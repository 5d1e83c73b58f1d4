"""Element trees, stories, rosters and the inbox on small tables."""

import random

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.text import normal_key
from ledgerline.operators import inbox, projects, segments, stories, structure

RAW = "intro text\n\n# One\npara one\nstill one\n\n- item a\n  tail\n  - item b\n## Two\n> q1\n> q2\n```\ncode # x\n\nmore\n```\nWORK EXPERIENCE\nlast words here."


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_elements(spark):
    docs = spark.createDataFrame([(1, RAW), (2, ""), (3, None)], "id int, text string")
    found = structure.elements(docs, "id")
    got = [(r["kind"], r["level"], r["parent"]) for r in found.orderBy("seq").collect()]
    assert got == [
        ("paragraph", None, None), ("heading", 1, None), ("paragraph", None, 1), ("item", 1, 1), ("item", 2, 1), ("heading", 2, 1), ("quote", None, 5), ("code", None, 5), ("heading", 1, None), ("paragraph", None, 8),
    ]
    assert all(RAW[r["start"] : r["end"]] == r["body"] for r in found.collect())
    assert segments.coverage_violations(docs, found.select("id", "start", "end", "body"), "id").count() == 0
    assert rows(structure.sections(found, "id"), F.asc_nulls_first("section")) == [(1, None, None, 1), (1, 1, "One", 7), (1, 8, "WORK EXPERIENCE", 2)]


def test_scraps_are_one_paragraph(spark):
    docs = spark.createDataFrame([(1, "one\n \ntwo\n\nthree\n\nA whole sentence stands here.\n\nAnother whole sentence follows it.")], "id int, text string")
    assert [r["body"].split() for r in structure.elements(docs, "id").orderBy("seq").collect()] == [["one", "two", "three"], ["A", "whole", "sentence", "stands", "here."], ["Another", "whole", "sentence", "follows", "it."]]


def test_element_chunks(spark):
    text = "First sentence is here. " * 100 + "\n\n---\n\n" + "y" * 2500
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    chunks = structure.element_chunks(structure.elements(docs, "id"), "id").orderBy("start").collect()
    assert all(text[r["start"] : r["end"]] == r["body"] and len(r["body"]) <= 1200 for r in chunks)
    assert chunks[0]["body"].endswith("here.") and "---" not in [r["body"] for r in chunks] and chunks[-1]["body"] == "y" * 100


CLAIMS = "id int, entity int, status string, action string, problem string, cost_dimension string, inefficiency string, outcome string, result_kind string, leverage int, flags array<string>, links int, at timestamp"


def test_story_content_and_readiness(spark):
    pain = "Reports were slow and took the team many days"
    claims = [
        (1, 7, "approved", "Built a loader", "too short", None, "slow", None, "missing", 2, [], 1, None),
        (2, 7, "approved", "Cut load time", pain, "time", "slow", "Load time fell by 40% of days", "quantified", 4, [], 1, None),
        (3, 7, "approved", "built  a LOADER", pain.upper(), "time", None, "load time fell by 40% of  DAYS", "quantified", 3, [], 1, None),
        (4, 7, "rejected", "Never", pain, "time", None, "Never", "quantified", 4, [], 9, None),
        (5, 8, "approved", "Wrote docs", None, None, None, None, "missing", 1, ["x"], 0, None),
        (6, 8, "approved", "Wrote more docs", None, None, None, None, "missing", 1, [], 0, None),
    ]
    got = {r["entity"]: r for r in stories.content(spark.createDataFrame(claims, CLAIMS)).collect()}
    assert got[7]["problem"] == pain and got[7]["problem_refs"] == [2, 3]
    assert got[7]["actions"] == ["Cut load time", "built  a LOADER"] and got[7]["results"] == ["Load time fell by 40% of days"]
    assert got[8]["problem"] is None and got[8]["actions"] == ["Wrote more docs", "Wrote docs"]
    states = stories.content(spark.createDataFrame(claims, CLAIMS)).withColumns({"attested_problem": F.lit(False), "attested_result": F.col("entity") == 8})
    ready = {r["entity"]: (r["ready"], r["missing"], r["questions"]) for r in stories.readiness(states).collect()}
    assert ready == {7: (True, [], []), 8: (False, ["problem"], ["missing_problem"])}


def test_problem_spaces(spark):
    problems = ["manual invoices took days each month", "invoices each month were manual and slow", "outage of the login page", "slow and manual"]
    frame = spark.createDataFrame([(1, p) for p in problems] + [(2, problems[2])], "entity int, key string")
    got = {(r["entity"], r["key"]): r["space"] for r in stories.problem_groups(frame).collect()}
    assert got[1, problems[0]] == got[1, problems[1]] != got[1, problems[2]] and len(got) == 5
    seeds = spark.createDataFrame([(1, "a", [1, 2]), (1, "b", [2, 3])], "entity int, space string, evidence array<int>")
    claims = spark.createDataFrame([(10, 1, [1]), (11, 1, [2]), (12, 1, [9]), (13, 1, [3, 3])], "id int, entity int, evidence array<int>")
    assert rows(stories.attach(claims, seeds), "id") == [(10, "a"), (13, "b")]
    members = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "entity int, id int, space string")
    live = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 5), (2, 6), (3, 7)], "entity int, id int")
    assert rows(stories.units(members, live), "id") == [(1, 1, "a"), (1, 2, "b"), (1, 3, "leftover"), (2, 5, "c"), (2, 6, "c"), (3, 7, "leftover")]


def test_home_spaces(spark):
    cited = spark.createDataFrame([("s", "x", "a", 1), ("s", "x", "a", 2), ("s", "x", "x", 3), ("t", "q", "a", 1), ("t", "q", "b", 2)], "story string, own string, space string, id int")
    assert rows(stories.home_space(cited), "story") == [("s", "x"), ("t", "b")]
    assert rows(stories.cross_space(cited), "story", "id") == [("s", 1), ("s", 2), ("t", 1)]


def test_groups_are_sanitized(spark):
    known = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "key string, place int")
    groups = spark.createDataFrame([("a", 0, 0), ("zz", 0, 1), ("a", 1, 0), ("b", 1, 1)], "key string, group_no int, place int")
    assert rows(stories.sanitized(groups, known), "key") == [("a", 0), ("b", 1), ("c", 4)]


def test_duplicates_and_bullets(spark):
    drafts = spark.createDataFrame([("g", 1, "s"), ("g", 2, "s"), ("g", 3, None), ("h", 4, "s")], "g string, id int, span string")
    assert [r["duplicate"] for r in stories.demoted(drafts, ["g"], "span", ["id"]).orderBy("id").collect()] == [False, True, False, False]
    picked = [("Built it.", "cut 40% of cost.", "p", "p", "p", "by 40%"), ("Built it", None, "p", "p", "p", ""), ("Built it", "saved 9 hours", "p", "q", "p", "saved hours")]
    got = stories.bullets(spark.createDataFrame(picked, "action string, result string, problem_space string, action_space string, result_space string, evidence string")).collect()
    assert [(r["violations"], r["bullet"]) for r in got] == [([], "Built it — cut 40% of cost."), (["result_missing"], None), (["space_mismatch", "unsupported_number:9"], None)]


ENTITY = "id int, name string, aliases array<string>, status string"


def test_rosters(spark):
    known = spark.createDataFrame([(1, "Paper System", ["ps"], "confirmed"), (2, "Other", [], "confirmed")], ENTITY)
    proposed = spark.createDataFrame([("paper  system", []), ("new", ["OTHER"]), ("fresh", [])], "name string, aliases array<string>")
    assert rows(projects.insert_or_match(known, proposed), "name") == [("fresh", None), ("new", 2), ("paper  system", 1)]
    assert rows(projects.renamed(known, spark.createDataFrame([(1, "ps")], "id int, new_name string")), "id")[0] == (1, "ps", ["Paper System"], "confirmed")
    owned = spark.createDataFrame([(10, 2), (11, 1)], "row int, entity int")
    entities, moved = projects.merged(known, owned, spark.createDataFrame([(2, 1)], "source int, target int"))
    assert rows(entities, "id") == [(1, "Paper System", ["ps", "Other"], "confirmed"), (2, "Other", [], "merged")] and {r["entity"] for r in moved.collect()} == {1}
    expected = spark.createDataFrame([("paper_system",), ("log_tool",), ("nothing",)], "expected string")
    texts = spark.createDataFrame([("I wrote a Log-Tool once",), ("x",)], "text string")
    assert rows(projects.reconciled(expected, known, texts), "expected") == [("log_tool", "present_in_source", None), ("nothing", "missing", None), ("paper_system", "detected", 1)]
    sources = spark.createDataFrame([("r1", "readme", "Tool", 1), ("d1", "drive", "tool", 2), ("c1", "commit", "x", 3), ("d2", "drive", "CV", 4), ("d3", "drive", " ", 5)], "source_ref string, source_type string, title string, place int")
    assert [(r["name"], r["kind"], r["aliases"]) for r in projects.proposals(sources).orderBy("name").collect()] == [("CV", "employer_role", []), ("Tool", "project", ["r1"])]
    pins = spark.createDataFrame([(1, 5, "human"), (2, None, None)], "id int, entity int, method string")
    assert rows(projects.pinned(pins, F.lit(9)), "id") == [(1, 5, "human"), (2, 9, "machine")]


MESSAGE = "message_id string, subject string, sender string, body string"


def test_inbox(spark):
    mails = [("1", "Hi", "jo@acme.io", "Hello\n we want to schedule a call for the Data Engineer role soon"), ("2", "interview", "x@y.z", "nothing"), ("3", "Re", "a@b.c", "unfortunately no interview"), ("4", "a", "nobody", "interview\n")]
    messages = spark.createDataFrame(mails, MESSAGE)
    got = {r["message_id"]: (r["company"], r["title"], r["quote"]) for r in inbox.detected(messages).collect()}
    assert got == {"1": ("Acme", "Data Engineer", "we want to schedule a call for the Data Engineer role soon"), "4": ("nobody", None, "interview")}
    again = spark.createDataFrame([("1", "Hello we want to   schedule a call for the Data Engineer role soon"), ("4", "changed")], "message_id string, body string")
    assert {r["message_id"]: r["problem"] for r in inbox.verified(inbox.detected(messages), again).collect()} == {"1": None, "4": "quote_not_in_body"}
    counts = inbox.scanned(messages, again, spark.createDataFrame([], "message_id string")).first()
    assert (counts["scanned"], counts["detected"], counts["verified"], counts["rejected"], counts["new"]) == (4, 2, 1, 1, 1)
    applications = spark.createDataFrame([(1, "ACME, Inc"), (2, "Acme Inc."), (3, "Else")], "id int, company string")
    interviews = spark.createDataFrame([("acme inc",), ("none",)], "company string")
    assert rows(inbox.with_applications(interviews, applications), "company") == [("acme inc", 2), ("none", None)]
    assert spark.range(1).select(normal_key(F.lit(" A  b "))).first()[0] == "a b"


def related(a, b, own, tags):
    return (a in b or b in a) and own[a] & own[b] or tags[a] & tags[b] and len(own[a] & own[b]) >= 2


def groups_by_pairs(texts, own, tags):
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and related(a, b, own, tags):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {t: find(t) for t in texts}


def test_problem_spaces_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["manual", "slow", "cost", "hours", "outage", *(f"word{k}" for k in range(25)), "the", "so"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(120)})
    frame = spark.createDataFrame([(e, t) for e in (1, 2) for t in texts if e == 1 or len(t) % 2], "entity int, key string")
    seen = {r["key"]: (set(r["own"]), set(r["tags"])) for r in frame.select("key", X.token_set(F.col("key")).alias("own"), X.pain_tags(F.col("key")).alias("tags")).collect()}
    own, tags = {t: v[0] for t, v in seen.items()}, {t: v[1] for t, v in seen.items()}
    got = {}
    for r in stories.problem_groups(frame).collect():
        got.setdefault(r["entity"], {})[r["key"]] = r["space"]
    for e in (1, 2):
        want = groups_by_pairs(list(got[e]), own, tags)
        assert len(got[e]) == frame.where(F.col("entity") == e).count()
        assert {frozenset(t for t in want if want[t] == w) for w in want.values()} == {frozenset(t for t in got[e] if got[e][t] == s) for s in got[e].values()}


def test_many_related_texts_take_links_in_proportion(spark):
    rows = spark.range(1500).select(F.lit(1).alias("entity"), F.concat(F.lit("manual reports took hours of case"), F.col("id").cast("string")).alias("key"))
    assert stories.problem_groups(rows).select("space").distinct().count() == 1


def test_conflicts_equal_all_pairs_and_come_latest_first(spark):
    from ledgerline.operators import entities

    rng = random.Random(9)
    words = [f"word{k}" for k in range(8)] + ["the", "x"]
    quotes = [(i, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), rng.choice([None, 1, 2, 3])) for i in range(90)]
    frame = spark.createDataFrame(quotes, "id int, sig string, text string, at int")
    own = {r["text"]: set(r["own"]) for r in frame.select("text", X.token_set(F.col("text")).alias("own")).collect()}
    near = lambda a, b: a != b and ((a in b or b in a) and own[a] & own[b] or own[a] | own[b] and 2 * len(own[a] & own[b]) >= len(own[a] | own[b]))
    held = [q for q in quotes if any(near(q[2], o[2]) for o in quotes if o[1] == q[1])]
    want = {s: (sum(q[1] == s for q in held), len({q[2] for q in held if q[1] == s})) for s in {q[1] for q in held}}
    assert {r["signature"]: (r["quotes"], r["wordings"]) for r in entities.metric_conflicts(frame, "id", "text", F.col("sig")).collect()} == want
    got = entities.ordered_conflicts(frame, "id", "text", "at", F.col("sig")).orderBy("signature", "place").collect()
    assert [(r["signature"], r["id"]) for r in got] == [(q[1], q[0]) for q in sorted(held, key=lambda q: (q[1], q[3] is None, -(q[3] or 0), q[0]))]
