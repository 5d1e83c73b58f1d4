"""Stored answers: shapes, grounding, and the gate behind them."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import extraction

GOOD = {"action": "Did it", "action_quote": "did it", "chunk_index": 0}


def answers(spark, *texts):
    return spark.createDataFrame([(g, t) for g, t in enumerate(texts)], "group int, answer string")


@pytest.mark.parametrize(
    ("text", "want"),
    [("```json\n{}\n```", "{}"), ("  ```\n[1]```  ", "[1]"), ("```{}```", "{}"), ("\n {} \n", "{}"), ("a ```json {} ``` b", "a ```json {} ``` b"), ("```json\n{\n```\n}\n```", "{\n```\n}"), ("", "")],
)
def test_fences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(extraction.unfenced(F.col("t"))).first()[0] == want


def test_reasons_for_answers_without_use(spark):
    cases = [
        (json.dumps({"claims": [GOOD]}), None), (json.dumps({"claims": []}), None), (None, "not_json"), ("", "not_json"), ("{'claims': []}", "not_json"), ("[]", "no_array"), ('{"claims": {"a": 1}}', "no_array"), ('{"claims": null}', "no_array"),
        (json.dumps({"claims": [GOOD, 3]}), "entry_not_object"), (json.dumps({"claims": [None]}), "entry_not_object"), (json.dumps({"claims": [GOOD | {"action": 3}]}), "action_missing"), (json.dumps({"claims": [GOOD | {"action": " \n"}]}), "action_missing"),
        (json.dumps({"claims": [GOOD | {"action_quote": ["x"]}]}), "quote_missing"), (json.dumps({"claims": [GOOD | {"chunk_index": 1.5}]}), "chunk_missing"), (json.dumps({"claims": [GOOD | {"chunk_index": None}]}), "chunk_missing"),
        (json.dumps({"claims": [GOOD | {"chunk_index": "0"}, 3]}), "chunk_missing"), (json.dumps({"claims": [3, GOOD | {"chunk_index": "0"}]}), "entry_not_object"),
    ]
    got = {r["group"]: r["reason"] for r in extraction.parsed(answers(spark, *(c[0] for c in cases)), "claims").collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    result = {"claim_index": 0, "chunk_index": 0, "outcome_quote": "q", "result_text": "t", "result_kind": " Quantified "}
    cases = [({}, None), ({"claim_index": "0"}, "chunk_missing"), ({"outcome_quote": ""}, "quote_missing"), ({"result_text": None}, "result_missing"), ({"result_kind": "missing"}, "kind_unknown"), ({"result_kind": 1}, "kind_unknown")]
    got = {r["group"]: r["reason"] for r in extraction.parsed(answers(spark, *(json.dumps({"results": [result | c[0]]}) for c in cases)), "results").collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_junk_in_optional_fields_is_left_out(spark):
    claim = GOOD | {"action": "  Did it ", "tools": ["a ", 1, "", None], "problem": {"text": " p ", "quote": "p", "chunk_index": True, "cost_dimension": "TIME", "inefficiency": "nonsense"}}
    (e,) = extraction.parsed(answers(spark, json.dumps({"claims": [claim]})), "claims").first()["entries"]
    assert (e["action"], e["tools"], e["problem_text"], e["problem_chunk"], e["cost_dimension"], e["inefficiency"]) == ("Did it", ["a"], "p", None, "time", None)
    for problem in ("text", {"text": "p"}, {"text": 1, "quote": "p"}, []):
        (e,) = extraction.parsed(answers(spark, json.dumps({"claims": [GOOD | {"problem": problem, "tools": "a"}]})), "claims").first()["entries"]
        assert e["problem_text"] is None and e["problem_quote"] is None and e["tools"] == []


def test_grounding_and_attachment(spark):
    chunks = spark.createDataFrame([(0, 0, "we  did it and\nsaved 5%"), (0, 1, "slow work"), (1, 0, "other")], "group int, chunk_index int, text string")
    problem = {"text": "slow", "quote": "slow work", "chunk_index": 1}
    first = {"claims": [GOOD | {"chunk_index": 1}, GOOD | {"problem": problem}, GOOD | {"action": "B", "action_quote": "we did it", "problem": problem | {"chunk_index": 0}}, GOOD | {"chunk_index": -1}]}
    r = {"claim_index": 1, "chunk_index": 0, "outcome_quote": "saved 5%", "result_text": "S", "result_kind": "quantified", "metric_text": "5%"}
    second = {"results": [r | {"claim_index": 2}, r | {"claim_index": -1}, r | {"metric_text": "6%"}, r | {"metric_text": None}, r | {"outcome_quote": "saved 6%"}, r | {"chunk_index": 9}, r, r | {"result_text": "late"}, r | {"claim_index": 0, "result_kind": "qualitative_evidenced", "metric_text": "zz"}]}
    drafts, ledger = extraction.grounded_drafts(chunks, answers(spark, json.dumps(first), json.dumps(first)), answers(spark, json.dumps(second), "nope"))
    got = [(d["claim_index"], d["action"], d["problem_text"], d["result_kind"], d["result_text"], d["metric_text"], d["outcome_quote"]) for d in drafts.where("group = 0").orderBy("claim_index").collect()]
    assert got == [(0, "Did it", "slow", "qualitative_evidenced", "S", None, "saved 5%"), (1, "B", None, "quantified", "S", "5%", "saved 5%")]
    told = sorted((x["group"], x["kind"], -1 if x["item"] is None else x["item"], x["reason"]) for x in ledger.collect())
    assert [t for t in told if t[0] == 0] == [
        (0, "claim", 0, "ungrounded_action"), (0, "claim", 3, "ungrounded_action"), (0, "problem", 2, "ungrounded_problem"), (0, "result", 0, "severed"), (0, "result", 1, "severed"), (0, "result", 2, "ungrounded_metric"),
        (0, "result", 3, "ungrounded_metric"), (0, "result", 4, "ungrounded_outcome"), (0, "result", 5, "ungrounded_outcome"), (0, "result", 7, "repeated"),
    ]
    assert [t for t in told if t[0] == 1] == [(1, "claim", i, "ungrounded_action") for i in range(4)]  # no claims, so results are not asked for


def test_groups_of_confirmed_entities(spark):
    entities = spark.createDataFrame([("a", "confirmed"), ("b", "proposed"), ("c", "confirmed")], "entity string, status string")
    evidence = spark.createDataFrame([("a", 2, True), ("a", 1, True), ("a", 0, False), ("b", 3, True)], "entity string, id int, active boolean")
    got = extraction.extraction_groups(entities, evidence, [F.col("id")]).select("group", "chunk_index", "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1), ("a", 1, 2)]


def test_dropped_drafts_come_back_from_json(spark):
    rows = spark.createDataFrame([("g", 1, "a", None, ["t"], ["action_fragment"]), ("g", 2, "b", "p", [], None)], "group string, place int, action string, problem string, tools array<string>, dropped array<string>")
    (row,) = extraction.dropped_json(rows, ["action", "problem", "tools"]).collect()
    assert json.loads(row["draft"]) == {"action": "a", "problem": None, "tools": ["t"]} and row["reasons"] == ["action_fragment"]


def test_ranked_ids(spark):
    shortlist = spark.createDataFrame([(g, i) for g in range(4) for i in "abc"], "group int, id string")
    e = lambda i, s, r=None: {"id": i, "score": s, "rationale": r}
    texts = [json.dumps({"ranking": [e("b", 3, " why "), e("x", 1), e("b", 1), e("a", 0.123456), e("c", -1)]}), json.dumps({"ranking": [e("a", "1")]}), json.dumps({"ranking": [e("a", True)]}), "```[]```"]
    got = extraction.ranked_ids(answers(spark, *texts), shortlist, 2).orderBy("group", "rank").collect()
    assert [tuple(r) for r in got] == [(0, "b", 1, 1.0, "why"), (0, "a", 2, 0.1235, "")]


def test_the_gate_judges_a_claim_once(spark, sf_dir):
    from ledgerline.plans import gate_queries

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    drafts, citations, chunks = gate_queries._gated(spark, sf_dir)
    n = drafts.count()
    gated = extraction.gate(drafts.withColumn("action", told("action")), citations, chunks).collect()
    assert len(gated) == n and seen.value == n and {r["demoted"] for r in gated} == {True, False}
