"""From stored answers of a model to claims that may be queued: shapes, grounding, and the gate.

Answers are checked as VARIANT values, whole: one bad entry makes an answer unusable, and the
ledger names the first reason. What is quoted must stand in the chunk that is cited; quotes meet their
chunks in one join on (group, chunk). Nothing is lost without a row in the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import lexicon as L
from ledgerline.functions import text as X
from ledgerline.operators.choice import DUPLICATE_OUTCOME, first_independent
from ledgerline.operators.statements import claim_violations
from ledgerline.tables import materialize

# fixed values: what makes a claim no candidate at all, what only says that a problem is absent, and kinds of results
STRUCTURAL, ABSENCE = ["problem_not_specific", "action_fragment"], ["problem_missing", "problem_not_pain_point"]
RESULT_KINDS = ["quantified", "qualitative_evidenced"]


def unfenced(text: Column) -> Column:
    """What stands inside a code fence around the whole text, or the text, without white space at its ends."""
    fence = r"(?s)^\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*$"
    return F.regexp_replace(F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text), r"^\s+|\s+$", "")


def _kind(value: Column, path: str = "$") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("NONE"))


def _text(value: Column, path: str) -> Column:
    """A text that isn't blank, else null."""
    found = F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))
    return F.when(~F.coalesce(found, F.lit("")).rlike(r"^\s*$"), found)


def _number(value: Column, path: str) -> Column:
    return F.when(_kind(value, path) == "BIGINT", F.try_variant_get(value, path, "bigint"))


def _one_of(value: Column, path: str, names: list[str]) -> Column:
    found = F.lower(F.trim(_text(value, path)))
    return F.when(found.isin(names), found)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _claim(e: Column) -> Column:
    tools = F.coalesce(F.try_variant_get(e, "$.tools", "array<variant>"), F.array().cast("array<variant>"))
    named = F.filter(F.transform(tools, lambda t: _stripped(_text(t, "$"))), lambda t: t.isNotNull())
    whole = _text(e, "$.problem.text").isNotNull() & (_kind(e, "$.problem.quote") == "STRING")
    problem = {"problem_text": _stripped(_text(e, "$.problem.text")), "problem_quote": F.try_variant_get(e, "$.problem.quote", "string"), "problem_chunk": _number(e, "$.problem.chunk_index")}
    problem |= {"cost_dimension": _one_of(e, "$.problem.cost_dimension", [n for n, _ in L.COSTS]), "inefficiency": _one_of(e, "$.problem.inefficiency", [n for n, _ in L.INEFFICIENCIES])}
    reason = (
        F.when(~F.startswith(_kind(e), F.lit("OBJECT")), "entry_not_object")
        .when(_text(e, "$.action").isNull(), "action_missing")
        .when(_text(e, "$.action_quote").isNull(), "quote_missing")
        .when(_number(e, "$.chunk_index").isNull(), "chunk_missing")
    )
    return F.struct(
        reason.alias("reason"), _stripped(_text(e, "$.action")).alias("action"), _text(e, "$.action_quote").alias("action_quote"), _number(e, "$.chunk_index").alias("action_chunk"), named.alias("tools"),
        *(F.when(whole, c).alias(n) for n, c in problem.items()),
    )


def _result(e: Column) -> Column:
    kind = _one_of(e, "$.result_kind", RESULT_KINDS)
    reason = (
        F.when(~F.startswith(_kind(e), F.lit("OBJECT")), "entry_not_object")
        .when(_number(e, "$.claim_index").isNull() | _number(e, "$.chunk_index").isNull(), "chunk_missing")
        .when(_text(e, "$.outcome_quote").isNull(), "quote_missing")
        .when(_text(e, "$.result_text").isNull(), "result_missing")
        .when(kind.isNull(), "kind_unknown")
    )
    return F.struct(
        reason.alias("reason"), _number(e, "$.claim_index").alias("claim_index"), _number(e, "$.chunk_index").alias("chunk"), _text(e, "$.outcome_quote").alias("outcome_quote"),
        _stripped(_text(e, "$.result_text")).alias("result_text"), kind.alias("result_kind"), _text(e, "$.metric_text").alias("metric_text"), _text(e, "$.resolves").alias("resolves"),
        _one_of(e, "$.result_type", [n for n, _ in L.RESULT_TYPES]).alias("result_type"),
    )


def parsed(answers: DataFrame, what: str) -> DataFrame:
    """(group, reason, entries) of answers (group, answer): ``what`` is ``claims`` or ``results``, an array of that name in an object.

    reason is null for a usable answer, else ``not_json``, ``no_array`` or the reason of the first bad entry;
    entries of unusable answers are null. A null answer is not_json.
    """
    rows = answers.select("group", F.try_parse_json(unfenced(F.col("answer"))).alias("v"))
    rows = rows.select("group", "v", F.try_variant_get("v", f"$.{what}", "array<variant>").alias("listed"))
    rows = rows.withColumn("entries", F.transform("listed", _claim if what == "claims" else _result))
    bad = F.get(F.filter(F.transform("entries", lambda e: e["reason"]), lambda r: r.isNotNull()), F.lit(0))
    reason = F.when(F.col("v").isNull(), "not_json").when(F.col("listed").isNull(), "no_array").otherwise(bad)
    return rows.select("group", reason.alias("reason"), "entries").withColumn("entries", F.when(F.col("reason").isNull(), F.col("entries")))


def _entries(answers: DataFrame) -> DataFrame:
    return answers.where("reason is null").select("group", F.posexplode("entries").alias("item", "e")).select("group", F.col("item").cast("long").alias("item"), "e.*").drop("reason")


def _grounded(rows: DataFrame, chunks: DataFrame, chunk: str, quotes: dict[str, Column]) -> DataFrame:
    """``rows`` with a boolean for each of ``quotes``: whether it stands in the chunk that the row cites; false without that chunk."""
    text = chunks.select(F.col("group").alias("g_"), F.col("chunk_index").cast("long").alias("c_"), F.col("text").alias("chunk_text_"))
    joined = rows.join(text, (F.col("group") == F.col("g_")) & (F.col(chunk) == F.col("c_")), "left")
    return joined.withColumns({n: F.coalesce(X.verbatim_in(q, F.col("chunk_text_")), F.lit(False)) for n, q in quotes.items()}).drop("g_", "c_", "chunk_text_")


def grounded_drafts(chunks: DataFrame, claim_answers: DataFrame, result_answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts and the ledger of what was not used.

    chunks: group, chunk_index, text. Both kinds of answers: group, answer, one a group. Claims whose action is
    not quoted from its chunk go; a problem that isn't goes alone. Results count claims from 0 among those that are
    left; the first usable one of a claim is attached.

    drafts: group, claim_index, action, tools, action_chunk, problem_text, problem_chunk, cost_dimension,
    inefficiency, result_text, result_kind (``missing`` without a result), result_chunk, outcome_quote, metric_text,
    resolves, result_type. ledger: group, kind (answer, claim, problem, result_answer, result), item, reason.
    """
    first, second = materialize(parsed(claim_answers, "claims")), materialize(parsed(result_answers, "results"))
    claims = _grounded(_entries(first), chunks, "action_chunk", {"action_ok": F.col("action_quote")})
    claims = materialize(_grounded(claims, chunks, "problem_chunk", {"problem_ok": F.col("problem_quote")}))
    kept = claims.where("action_ok").withColumn("claim_index", F.row_number().over(W.partitionBy("group").orderBy("item")).cast("long") - 1)
    counts = kept.groupBy("group").agg(F.count(F.lit(1)).alias("n_claims"))
    usable = second.join(counts.select("group"), "group", "left_semi")
    results = _grounded(_entries(usable).join(counts, "group"), chunks, "chunk", {"quote_ok": F.col("outcome_quote"), "metric_ok": F.col("metric_text")})
    counted = F.col("result_kind") == "quantified"
    lost = F.when((F.col("claim_index") < 0) | (F.col("claim_index") >= F.col("n_claims")), "severed").when(~F.col("quote_ok"), "ungrounded_outcome").when(counted & ~F.col("metric_ok"), "ungrounded_metric")
    results = results.withColumn("lost", lost)
    nth = F.row_number().over(W.partitionBy("group", "claim_index", F.col("lost").isNull()).orderBy("item"))
    results = materialize(results.withColumn("lost", F.when(F.col("lost").isNull() & (nth > 1), "repeated").otherwise(F.col("lost"))))
    item = F.lit(None).cast("long").alias("item")
    ledger = first.where("reason is not null").select("group", F.lit("answer").alias("kind"), item, "reason")
    ledger = ledger.unionByName(claims.where(~F.col("action_ok")).select("group", F.lit("claim").alias("kind"), "item", F.lit("ungrounded_action").alias("reason")))
    ledger = ledger.unionByName(kept.where(F.col("problem_text").isNotNull() & ~F.col("problem_ok")).select("group", F.lit("problem").alias("kind"), "item", F.lit("ungrounded_problem").alias("reason")))
    ledger = ledger.unionByName(usable.where("reason is not null").select("group", F.lit("result_answer").alias("kind"), item, "reason"))
    ledger = ledger.unionByName(results.where("lost is not null").select("group", F.lit("result").alias("kind"), "item", F.col("lost").alias("reason")))
    problem = [F.when(F.col("problem_ok"), F.col(c)).alias(c) for c in ("problem_text", "problem_chunk", "cost_dimension", "inefficiency")]
    attached = results.where("lost is null").select("group", "claim_index", "result_text", "result_kind", F.col("chunk").alias("result_chunk"), "outcome_quote", "metric_text", "resolves", "result_type")
    drafts = kept.select("group", "claim_index", "action", "tools", "action_chunk", *problem).join(attached, ["group", "claim_index"], "left")
    drafts = drafts.withColumns({"result_kind": F.coalesce("result_kind", F.lit("missing")), "metric_text": F.when(F.col("result_kind") == "quantified", F.col("metric_text"))})
    return drafts, ledger


def extraction_groups(entities: DataFrame, evidence: DataFrame, order: list[Column]) -> DataFrame:
    """(group, chunk_index, evidence columns): the evidence in use (entity, active) of confirmed entities (entity, status), counted from 0 in ``order``."""
    own = evidence.where("active").join(entities.where("status = 'confirmed'").select("entity"), "entity", "left_semi")
    return own.withColumn("chunk_index", F.row_number().over(W.partitionBy("entity").orderBy(*order)).cast("long") - 1).withColumnRenamed("entity", "group")


def outside_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group, place, outside): sorted codes for what drafts cite (group, place, field, source_type, source_ref) from beyond their group's chunks."""
    beyond = citations.join(chunks.select("group", "source_type", "source_ref").distinct(), ["group", "source_type", "source_ref"], "left_anti")
    code = F.when(F.col("field") == "result", "result_project_mismatch").otherwise("evidence_outside_project")
    return beyond.groupBy("group", "place").agg(F.array_sort(F.collect_set(F.concat(code, F.lit(":"), F.col("source_ref")))).alias("outside"))


def bounced_groups(drafts: DataFrame) -> DataFrame:
    """(group, violations): groups to be extracted once more, as some draft has a fault that another try can mend; all faults are told."""
    checked = claim_violations(drafts)
    fixable = F.exists("violations", lambda v: ~v.isin(ABSENCE))
    told = checked.groupBy("group").agg(F.max(fixable).alias("bounced"), F.array_sort(F.collect_set(F.struct("place", "violations"))).alias("all"))
    return told.where("bounced").select("group", F.flatten(F.transform("all", lambda d: d["violations"])).alias("violations"))


def gate(drafts: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """``drafts`` with dropped, flags, demoted and result_status.

    drafts: group, place and the columns of ``statements.claim_violations`` with result_links (source_ref,
    outcome_quote, chunk_text) and metric_text. dropped: the codes for which a draft is no candidate, null for the
    others. Of these, in order of place, an outcome span (ref and quote) backs one result; a later draft
    with it keeps its work, loses the result and is flagged. Codes of absence are no flags. result_status is
    ``verified`` for a result without flags, else ``unverified``.
    """
    rows = claim_violations(drafts).join(outside_citations(citations, chunks), ["group", "place"], "left")
    codes = F.concat(F.filter("violations", lambda v: v.isin(STRUCTURAL)), F.coalesce("outside", F.array().cast("array<string>")))
    # a claim is judged once: a filter on what comes of it would have it judged again for each use
    rows = materialize(rows.withColumn("dropped", F.when(F.size(codes) > 0, codes)).drop("outside"))
    quoted = F.filter("result_links", lambda x: F.trim(F.coalesce(x["outcome_quote"], F.lit(""))) != "")
    spans = F.transform(quoted, lambda x: F.concat(x["source_ref"], F.lit("\x1f"), X.squeezed(x["outcome_quote"])))
    chosen, _ = first_independent(rows.where("dropped is null").withColumn("spans_", spans), ["group"], "place", "spans_")
    none = {c: F.lit(None).cast(chosen.schema[c].dataType) for c in ("outcome", "metric_text", "resolves")}
    stripped = none | {"result_kind": F.lit("missing"), "result_links": F.slice("result_links", 1, 0)}
    lost = claim_violations(chosen.where(~F.col("kept")).drop("violations").withColumns(stripped))
    flags = F.filter("violations", lambda v: ~v.isin(ABSENCE))
    left = chosen.where("kept").withColumn("flags", flags).unionByName(lost.withColumn("flags", F.array_append(flags, F.lit(DUPLICATE_OUTCOME))))
    left = left.withColumn("demoted", ~F.col("kept")).drop("violations", "kept", "spans_")
    status = F.when((F.size("flags") == 0) & (F.col("result_kind") != "missing"), "verified").otherwise("unverified")
    gone = rows.where("dropped is not null").drop("violations").withColumns({"demoted": F.lit(False), "flags": F.array().cast("array<string>")})
    return left.withColumn("result_status", status).unionByName(gone.withColumn("result_status", F.lit(None).cast("string")))


def dropped_json(drafts: DataFrame, columns: list[str]) -> DataFrame:
    """(group, place, reasons, draft): dropped drafts whole, as JSON that ``from_json`` reads back; nulls are kept."""
    return drafts.where("dropped is not null").select("group", "place", F.col("dropped").alias("reasons"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("draft"))


def ranked_ids(answers: DataFrame, shortlist: DataFrame, most: int) -> DataFrame:
    """(group, id, rank, score, rationale) of answers (group, answer) that rank ids of a shortlist (group, id).

    Ids that the shortlist lacks, and repeated ones, are passed over; the order of the answer counts, not its
    scores, which are clamped to 0..1. Answers of another shape rank nothing.
    """
    rows = answers.select("group", F.try_variant_get(F.try_parse_json(unfenced(F.col("answer"))), "$.ranking", "array<variant>").alias("entries"))
    number = lambda e: F.when(_kind(e, "$.score").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(e, "$.score", "double"))
    fields = lambda e: F.struct(_text(e, "$.id").alias("id"), number(e).alias("score"), _stripped(_text(e, "$.rationale")).alias("rationale"))
    rows = rows.withColumn("entries", F.transform("entries", fields)).where(F.forall("entries", lambda e: e["id"].isNotNull() & e["score"].isNotNull()))
    found = rows.select("group", F.posexplode("entries").alias("at", "e")).select("group", "at", "e.*").join(shortlist.select("group", "id"), ["group", "id"], "left_semi")
    once = found.withColumn("nth", F.row_number().over(W.partitionBy("group", "id").orderBy("at"))).where("nth = 1")
    once = once.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy("at"))).where(F.col("rank") <= most)
    return once.select("group", "id", "rank", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")), 4).alias("score"), F.coalesce("rationale", F.lit("")).alias("rationale"))
