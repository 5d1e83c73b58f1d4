"""Plans that people and runs make: edits of claims before approval, story drafts, stale drafts, stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.changes import change

# fixed values: fields of an edit, the kind of evidence that holds what a person has said, and decided states of stories
TEXTS = ["problem_text", "cost_dimension", "inefficiency", "action_text", "result_text", "result_kind", "metric"]
ATTESTED = "user_attestation"
DECIDED = ["approved", "excluded"]


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def checked_edits(claims: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with the claim beside them (``was``), the text each edited part will have, and ``refused``: the first reason against the edit, null if none.

    claims: id, status, problem_text, action_text, result_text, result_kind. edits: id, the columns of TEXTS
    and action_tools (an array); null leaves a field as it is. One edit a claim.
    """
    was = F.struct("status", "problem_text", "action_text", "result_text", "result_kind")
    rows = edits.join(claims.select("id", was.alias("was")), "id", "left")
    given = {c: F.col(c).isNotNull() for c in (*TEXTS, "action_tools")}
    part = lambda *names: reduce(lambda a, b: a | b, [given[n] for n in names])
    rows = rows.withColumns({
        "edits_problem": part("problem_text", "cost_dimension", "inefficiency"), "edits_action": part("action_text", "action_tools"), "edits_result": part("result_text", "result_kind", "metric"),
        "new_problem": F.coalesce("problem_text", "was.problem_text"), "new_action": F.coalesce("action_text", "was.action_text"), "new_result": F.coalesce("result_text", "was.result_text"),
    })
    refused = (
        F.when(F.col("was").isNull(), "unknown_claim")
        .when(F.col("was.status") != "pending_review", "not_editable")
        .when(~(F.col("edits_problem") | F.col("edits_action") | F.col("edits_result")), "no_edits")
        .when(F.col("result_kind") == "missing", "kind_missing")
        .when(given["result_text"] & ~given["result_kind"], "kind_needed")
        .when(given["result_kind"] & ~given["result_text"] & F.col("was.result_text").isNull(), "text_needed")
        .when(F.col("edits_problem") & _blank(F.col("new_problem")), "problem_empty")
        .when(F.col("edits_action") & _blank(F.col("new_action")), "action_empty")
        .when(F.col("edits_result") & _blank(F.col("new_result")), "result_empty")
    )
    return rows.withColumn("refused", refused)


def edit_changes(checked: DataFrame) -> DataFrame:
    """Changes of ``claims``, ``evidence`` and ``links`` for the edits that nothing refuses.

    Every part that an edit touches is attested as a whole: its text becomes evidence of its own, one row a claim
    and part, linked to the claim. Flags are cleared: the person outranks the checks.
    """
    rows = checked.where("refused is null")
    fields = {c: F.col(c) for c in ("cost_dimension", "inefficiency", "action_tools", "metric")}
    fields |= {f"{p}_text": F.when(F.col(f"edits_{p}"), F.col(f"new_{p}")) for p in ("problem", "action", "result")}
    fields |= {"result_kind": F.when(F.col("edits_result"), F.coalesce("result_kind", "was.result_kind")), "result_status": F.when(F.col("edits_result"), "user_attested"), "flags": F.array().cast("array<string>")}
    out = change(rows, "claims", "update", {"id": F.col("id")}, fields, untouched=True)
    parts = F.array(*(F.struct(F.lit(p).alias("field"), F.col(f"edits_{p}").alias("edited"), F.col(f"new_{p}").alias("text")) for p in ("problem", "action", "result")))
    said = rows.select("id", F.explode(F.filter(parts, lambda p: p["edited"])).alias("p")).select("id", "p.field", "p.text", F.concat(F.lit("claim:"), F.col("id").cast("string"), F.lit(":"), F.col("p.field")).alias("ref"))
    source = {"source_type": F.lit(ATTESTED), "source_ref": F.col("ref")}
    out = out.unionByName(change(said, "evidence", "upsert", source, {"text": F.col("text")}))
    return out.unionByName(change(said, "links", "upsert", {"id": F.col("id"), **source, "field": F.col("field")}, {"quote": F.when(F.col("field") == "result", F.col("text"))}))


def draft_changes(stories: DataFrame, units: DataFrame, answered: DataFrame, target: str = "stories") -> DataFrame:
    """Changes that bring the drafts of the entities in ``units`` up to it; decided stories never change.

    units: entity, space, content. stories: entity, space. answered (entity, space): stories for which a person
    has typed an answer. A unit's draft is made or written anew and goes to review; a draft whose
    space is no longer among its entity's units goes, unless it is answered.
    """
    key = {"entity": F.col("entity"), "space": F.col("space")}
    written = change(units, target, "upsert", key, {"content": F.col("content"), "status": F.lit("pending_review"), "reviewed_at": F.lit(None), "note": F.lit(None)})
    stale = stories.join(units.select("entity").distinct(), "entity", "left_semi").join(units.select("entity", "space"), ["entity", "space"], "left_anti").join(answered.select("entity", "space"), ["entity", "space"], "left_anti")
    return written.unionByName(change(stale, target, "delete", key, {}))


def invalidations(stories: DataFrame, reasons: DataFrame, target: str = "stories") -> DataFrame:
    """Changes that make drafts of all stories of the entities in ``reasons`` (entity, reason), decided ones too; the note keeps what had been decided, and when."""
    rows = stories.join(reasons, "entity")
    when = F.coalesce(F.date_format("reviewed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown time"))
    before = F.when(F.col("status").isin(DECIDED), F.concat(F.lit(" (previously "), F.col("status"), F.lit(" at "), when, F.lit(")")))
    note = F.concat(F.lit("invalidated: "), F.col("reason"), F.coalesce(before, F.lit("")))
    return change(rows, target, "update", {"entity": F.col("entity"), "space": F.col("space")}, {"status": F.lit("draft"), "reviewed_at": F.lit(None), "note": note}, yields=False)


def stamps(rows: DataFrame, target: str, key: list[str], columns: list[str], place: int = 0) -> DataFrame:
    """Changes that set ``columns`` of the rows with these keys; nulls count."""
    return change(rows, target, "update", {c: F.col(c) for c in key}, {c: F.col(c) for c in columns}, place)


def packet_changes(packets: DataFrame, target: str = "packets") -> DataFrame:
    """Changes that save packets (interview, content), one an interview; give the target its interviews as parent."""
    return change(packets, target, "upsert", {"interview": F.col("interview")}, {"content": F.col("content")})
