"""Statements of texts, their roles, and claims assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.lexicon import MID_CLAUSE

LABEL = r"(?i)^(problem|action|result)\s*:\s*(.+)$"
BULLET = r"^[-*•]\s+"


def split_statements(chunks: DataFrame, chunk_col: str, text_col: str) -> DataFrame:
    """A row per statement: the other columns of ``chunks``, position, statement, label.

    Lines lose bullets; blank lines and headers go; a labelled line is one
    statement, others are parted into sentences. ``position`` counts from 0 per chunk.
    """
    lines = chunks.select("*", F.posexplode(F.split(F.col(text_col), "\r\n|\r|\n")).alias("line_no", "raw_line"))
    lines = lines.withColumn("line", F.regexp_replace(F.trim("raw_line"), BULLET, "")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    labelled = F.col("line").rlike(LABEL)
    parts = F.when(labelled, F.array(F.trim(F.regexp_extract("line", LABEL, 2)))).otherwise(X.sentences(F.col("line")))
    each = lines.withColumn("label", F.when(labelled, F.lower(F.regexp_extract("line", LABEL, 1)))).select("*", F.posexplode(parts).alias("part_no", "part"))
    each = each.withColumn("statement", F.trim("part")).where(F.col("statement") != "")
    order = W.partitionBy(chunk_col).orderBy("line_no", "part_no")
    return each.withColumn("position", F.row_number().over(order) - 1).select(*(c for c in chunks.columns if c != text_col), "position", "statement", "label")


def with_roles(statements: DataFrame) -> DataFrame:
    """``statements`` with role, result_type, result_kind, cost_dimension and inefficiency."""
    s = F.col("statement")
    return statements.withColumns(
        {"role": X.role(s, F.col("label")), "result_type": X.result_type(s), "result_kind": X.result_kind(s), "cost_dimension": X.cost_dimension(s), "inefficiency": X.inefficiency(s)}
    )


def forward_fill(rows: DataFrame, group: list[str], order: list[str], value, name: str) -> DataFrame:
    """``rows`` with ``name``: the last value that isn't null above each row in its group, never its own."""
    above = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(above))


def extract_claims(chunks: DataFrame, group_col: str, chunk_col: str, text_col: str) -> DataFrame:
    """A row per work statement with the problem above it in its chunk and the outcome attached to it.

    The k-th outcome of a chunk goes to the chunk's k-th claim; outcomes left
    over go, in order of chunk and position, to the claims of the group still
    without one, in the same order. Nothing is paired backwards or invented.
    """
    rows = with_roles(split_statements(chunks.select(group_col, chunk_col, text_col), chunk_col, text_col))
    rows = forward_fill(rows, [group_col, chunk_col], ["position"], F.when(F.col("role") == "problem", F.col("statement")), "problem")
    # works and outcomes are paired by grouping, each read once; a null key pairs nothing
    nth = F.row_number().over(W.partitionBy(group_col, chunk_col, "role").orderBy("position"))
    told = rows.where("role in ('work', 'outcome')").select(group_col, chunk_col, "position", "role", "statement", "problem").withColumn("k", nth)
    told = told.withColumn("alone", F.when(F.col(group_col).isNull() | F.col(chunk_col).isNull(), F.col("role")))
    work = F.col("role") == "work"
    near = told.groupBy(group_col, chunk_col, "k", "alone").agg(
        F.coalesce(F.max(F.when(work, F.col("position"))), F.max("position")).alias("position"), F.max(F.when(work, F.col("statement"))).alias("action"), F.max(F.when(work, F.col("problem"))).alias("problem"), F.max(F.when(~work, F.col("statement"))).alias("outcome")
    )
    waits = F.col("outcome").isNull()
    single = near.withColumns({"pair": F.col("action").isNotNull() & ~waits, "waits": waits})
    w = F.row_number().over(W.partitionBy(group_col, "pair", "waits").orderBy(chunk_col, "position"))
    of = lambda c: F.max(F.when(F.col("action").isNotNull(), F.col(c))).alias(c)
    apart = F.when(F.col("pair") | F.col(group_col).isNull(), F.struct("pair", "waits"))
    claims = single.withColumns({"w": w, "apart": apart}).groupBy(group_col, "w", "apart").agg(of(chunk_col), of("position"), of("action"), of("problem"), F.max("outcome").alias("outcome")).where("action is not null")
    claims = claims.select(group_col, chunk_col, "position", "action", "problem", "outcome")
    a, p, o = F.col("action"), F.col("problem"), F.col("outcome")
    declared = F.array_compact(F.array(X.cost_dimension(p), X.inefficiency(p)))
    return claims.withColumns(
        {
            "tools": X.tools(a), "cost_dimension": X.cost_dimension(p), "inefficiency": X.inefficiency(p), "result_kind": F.when(o.isNull(), "missing").otherwise(X.result_kind(o)),
            "result_type": X.result_type(o), "resolves": F.when(o.isNotNull(), X.resolves(o, declared)),
        }
    )


_EVIDENCE = {"result_links", "metric_text"}


def _evidence_rules(claims: DataFrame, missing: Column) -> list[tuple[str, Column]]:
    """What can be wrong with the evidence of an outcome, for claims that carry it."""
    if not _EVIDENCE <= set(claims.columns):
        return []
    links, metric = F.col("result_links"), F.trim(F.coalesce("metric_text", F.lit("")))
    quoted = lambda link: F.trim(F.coalesce(link["outcome_quote"], F.lit("")))
    counted = F.col("result_kind") == "quantified"
    found = lambda text, link: F.coalesce(X.verbatim_in(text, link["chunk_text"]), F.lit(False))
    return [
        ("result_evidence_missing", ~missing & (F.coalesce(F.size(links), F.lit(0)) <= 0)),
        ("outcome_quote_missing", ~missing & F.exists(links, lambda link: quoted(link) == "")),
        ("outcome_quote_not_verbatim", ~missing & F.exists(links, lambda link: (quoted(link) != "") & ~found(quoted(link), link))),
        ("result_metric_json_missing", counted & (metric == "")),
        ("result_metric_not_verbatim", counted & (metric != "") & ~F.coalesce(F.exists(links, lambda link: found(F.trim("metric_text"), link)), F.lit(False))),
    ]


def claim_violations(claims: DataFrame) -> DataFrame:
    """``claims`` with violations: codes of what is wrong, in order; an empty array for a claim that passes.

    Needs action, problem, tools, cost_dimension, inefficiency, outcome,
    result_kind and resolves, as ``extract_claims`` gives them. With the columns
    ``result_links`` (an array of outcome_quote and chunk_text, the evidence cited
    for the outcome) and ``metric_text``, the evidence is checked too: quotes and
    metric must stand in the chunks word for word. A code comes once per claim.
    """
    a, p, o = F.coalesce(F.trim("action"), F.lit("")), F.coalesce(F.trim("problem"), F.lit("")), F.coalesce(F.trim("outcome"), F.lit(""))
    count = lambda c: F.size(F.split(X.squeezed(c), " "))
    bare = F.regexp_replace(a, r"[.!?]+$", "")
    ending = F.lower(F.regexp_replace(F.element_at(F.split(bare, r"\s+"), -1), r"[^\w]+$", ""))
    missing = F.col("result_kind") == "missing"
    declared = F.array_compact(F.array("cost_dimension", "inefficiency"))
    cited = (F.size("result_links") > 0) | F.col("metric_text").isNotNull() if _EVIDENCE <= set(claims.columns) else F.lit(False)

    rules = [
        ("problem_missing", p == ""),
        ("problem_not_pain_point", (p != "") & (F.size(declared) == 0)),
        ("problem_not_specific", (p != "") & ((count(p) < 6) | F.contains(X.normal_key(a), X.normal_key(p)) | X.looks_like_artifact(p))),
        ("action_missing", a == ""),
        ("action_names_no_tools", (a != "") & (F.size("tools") == 0)),
        ("action_tool_not_in_text", (a != "") & F.exists("tools", lambda t: ~F.contains(F.lower(a), F.lower(t)))),
        ("action_fragment", (a != "") & ((count(a) < 5) | bare.rlike(r"[,;–—-]$") | ending.isin(MID_CLAUSE))),
        ("missing_result_filled", missing & ((o != "") | cited)),
        ("result_text_missing", ~missing & (o == "")),
        *_evidence_rules(claims, missing),
        ("result_problem_coupling", ~missing & ~F.coalesce(F.array_contains(declared, F.col("resolves")), F.lit(False))),
    ]
    return claims.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules])))
