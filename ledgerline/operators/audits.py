"""Scorecards, evaluations and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import squeezed


def share(part: Column, whole: Column, empty: float = 0.0, digits: int = 4) -> Column:
    """A ratio with a defined value for nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(empty))


def percent(flag: Column) -> Column:
    """Percentage of rows that have the flag, to three decimals; 100 for no rows."""
    return F.coalesce(F.round(100.0 * F.avg(flag.cast("int")), 3), F.lit(100.0))


def slop(rows: DataFrame, fragment: Column, unspecific: Column, fingerprint: Column, missing: Column, flagged: Column) -> DataFrame:
    """One row: how many rows there are, counts of each kind of slop, and their rates (0 when empty)."""
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fragment).alias("fragments"),
        F.count_if(unspecific).alias("unspecific"),
        (F.count(F.lit(1)) - F.count_distinct(fingerprint)).alias("duplicates"),
        F.count_if(missing).alias("missing_results"),
        F.count_if(flagged).alias("flagged"),
    )
    rates = {f"{c}_rate": share(F.col(c), F.col("total")) for c in ("fragments", "unspecific", "duplicates", "missing_results", "flagged")}
    return counted.withColumns(rates)


def golden_summary(decided: DataFrame, approved: Column, rejected: Column, reason: Column, top: int = 5) -> DataFrame:
    """(reason, times, place, approved, rejected): the commonest reasons of rejections beside the totals."""
    reasons = decided.where(rejected).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "reason").limit(top)
    totals = decided.agg(F.count_if(approved).alias("approved"), F.count_if(rejected).alias("rejected")).first()
    return reasons.select("reason", "times", F.lit(totals["approved"]).alias("approved"), F.lit(totals["rejected"]).alias("rejected"))


def check(name: str, rows: DataFrame, failed: Column, subject: Column, most: int = 20) -> DataFrame:
    """One row of an audit: (check_name, checked, failed, passes, examples), with the smallest ``most`` subjects that failed.

    The rows are read once: counts and examples both come from one grouping by failed subjects.
    """
    told = rows.select(F.coalesce(failed, F.lit(False)).alias("f"), subject.cast("string").alias("s"))
    # grouped by the subject alone, and with both counts looked at on both sides, so that they share one shuffle
    found = told.groupBy(F.when(F.col("f"), F.col("s")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("n_failed"))
    failures = found.where("n > 0 and n_failed > 0").orderBy(F.asc_nulls_last("s")).limit(most)
    repeated = F.array_repeat("s", F.least("n_failed", F.lit(most)).cast("int"))
    listed = F.array_sort(F.flatten(F.collect_list(F.when(F.col("s").isNotNull(), repeated))))
    examples = failures.agg(F.array_join(F.slice(listed, 1, most), ",").alias("examples"))
    counted = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed"))
    named = counted.select(F.lit(name).alias("check_name"), "checked", "failed", (F.col("failed") == 0).alias("passes"))
    return named.join(F.broadcast(examples.withColumn("check_name", F.lit(name))), "check_name")  # one row each


def scorecard(checks: list[DataFrame]) -> DataFrame:
    """All checks of an audit."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def captured(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Evidence in use (id, source, ref) stands on a stored version (source, ref, raw; one of each source and ref) that has text."""
    stored = evidence.join(versions.select("source", "ref", "raw"), ["source", "ref"], "left")
    return check("capture", stored, F.length(F.coalesce("raw", F.lit(""))) == 0, F.col("id"))


def ownership_labelled(evidence: DataFrame) -> DataFrame:
    """Evidence in use (id, entity, method) that has an entity says how it came there."""
    return check("ownership_labeled", evidence.where("entity is not null"), F.coalesce("method", F.lit("")) == "", F.col("id"))


def reviewed_on_stale(claims: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Approved claims (id, status) cite (claim, evidence) no evidence (id, active) that has been replaced; unknown evidence is another check's."""
    stale = links.join(evidence.where("not active").select(F.col("id").alias("evidence")), "evidence", "left_semi").select(F.col("claim").alias("id")).distinct()
    approved = claims.where("status = 'approved'").join(stale.withColumn("on_stale", F.lit(True)), "id", "left")
    return check("reviewed_on_stale", approved, F.col("on_stale").isNotNull(), F.col("id"))


def version_consistency(rows: DataFrame, current: dict[str, int]) -> DataFrame:
    """Rows (kind, id, version) carry the current version of their kind; kinds that ``current`` does not name have none and fail."""
    now = F.lit(None)
    for kind, version in current.items():
        now = F.when(F.col("kind") == kind, version).otherwise(now)
    return check("version_consistency", rows, ~F.col("version").eqNullSafe(now) | now.isNull(), F.concat_ws(":", "kind", "id"))


def entity_coverage(entities: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Confirmed entities (id, status) have evidence in use (entity) and claims (entity)."""
    fed, processed = (rows.where("entity is not null").select(F.col("entity").alias("id")).distinct().withColumn(name, F.lit(True)) for rows, name in ((evidence, "fed"), (claims, "processed")))
    rows = entities.where("status = 'confirmed'").join(fed, "id", "left").join(processed, "id", "left")
    return check("entity_coverage", rows, F.col("fed").isNull() | F.col("processed").isNull(), F.col("id"))


def run_log(rows: DataFrame, at: Column, kind: Column, passed: Column) -> DataFrame:
    """(day, kind, runs, passed, pass_rate) of an append-only log."""
    counted = rows.groupBy(F.to_date(F.date_trunc("day", at)).alias("day"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(passed).alias("passed"))
    return counted.withColumn("pass_rate", share(F.col("passed"), F.col("runs")))


def element_coverage(documents: DataFrame, faults: DataFrame) -> DataFrame:
    """Documents in use (id) have element trees that cover them: no row of ``faults`` (id, start, reason)."""
    broken = faults.select("id").distinct().withColumn("broken", F.lit(True))
    return check("element_coverage", documents.join(broken, "id", "left"), F.col("broken").isNotNull(), F.col("id"))


def active_orphans(evidence: DataFrame, elements: DataFrame) -> DataFrame:
    """Evidence in use (id, version, element, recomputes) stands on an element (element, version) of its version, if on any, and its text comes out of the version's; evidence without a version is another check's."""
    owners = elements.select("element", F.col("version").alias("owner"))
    rows = evidence.join(owners, "element", "left")
    stray = F.col("element").isNotNull() & ~F.col("owner").eqNullSafe(F.col("version"))
    return check("active_orphans", rows, F.col("version").isNotNull() & (stray | ~F.coalesce("recomputes", F.lit(False))), F.col("id"))


def provenance_walk(stories: DataFrame, components: DataFrame, claims: DataFrame, links: DataFrame, evidence: DataFrame, attestations: DataFrame) -> DataFrame:
    """Every component of a story walks to claims of its entity and from there to evidence; quotes stand in evidence cited for results; without a problem or a result a person has attested one.

    stories: story, entity. components: story, kind, component_id, claim_ids, outcome_quote. claims: id, entity. links:
    claim, evidence, field. evidence: id, text. attestations: story, kind.
    """
    cited = components.join(stories, "story").select("story", "entity", "kind", "component_id", F.explode("claim_ids").alias("claim"))
    walked = cited.join(claims.select(F.col("id").alias("claim"), F.col("entity").alias("owner")), "claim", "left")
    lost = walked.where(~F.col("owner").eqNullSafe(F.col("entity"))).select("story")
    good = walked.where(F.col("owner").eqNullSafe(F.col("entity")))
    reached = good.join(links, "claim").join(evidence.select(F.col("id").alias("evidence"), F.col("text").alias("chunk")), "evidence", "left")
    broken = reached.where("chunk is null").select("story")
    shown = reached.where("field = 'result'").groupBy("story", "component_id").agg(F.array_join(F.collect_list(squeezed(F.col("chunk"))), " ").alias("chunks"))
    quoted = components.where("kind = 'result' and coalesce(outcome_quote, '') <> ''").join(shown, ["story", "component_id"], "left")
    unseen = quoted.where(~F.contains(F.coalesce("chunks", F.lit("")), squeezed(F.col("outcome_quote")))).select("story")
    have = components.where("kind = 'problem' and size(claim_ids) > 0").select("story", "kind").unionByName(good.where("kind = 'result'").select("story", "kind")).unionByName(attestations.select("story", "kind")).distinct()
    need = stories.select("story", F.explode(F.array(F.lit("problem"), F.lit("result"))).alias("kind"))
    bare = need.join(have, ["story", "kind"], "left_anti").select("story")
    failed = lost.unionByName(broken).unionByName(unseen).unionByName(bare).distinct().withColumn("lost", F.lit(True))
    return check("provenance_walk", stories.join(failed, "story", "left"), F.col("lost").isNotNull(), F.col("story"))


def golden_examples(claims: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, status, note, action, problem, result, evidence) of decided claims (approved or rejected), each with its evidence in order of its links.

    links: claim, place, evidence, field, quote. evidence: id, source_type, source_ref, text. Links to unknown evidence keep their
    field and quote; a claim without links has an empty list.
    """
    shown = links.join(evidence.select(F.col("id").alias("evidence"), "source_type", "source_ref", "text"), "evidence", "left")
    listed = shown.groupBy(F.col("claim").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "evidence", "field", "source_type", "source_ref", "text", "quote"))).alias("listed"))
    rows = claims.where("status in ('approved', 'rejected')").join(listed, "id", "left")
    bare = F.transform(F.coalesce("listed", F.array().cast(listed.schema["listed"].dataType)), lambda e: F.struct(*(e[c].alias(c) for c in ("field", "source_type", "source_ref", "text", "quote"))))
    return rows.select("id", "status", "note", "action", "problem", "result", bare.alias("evidence"))


def union_of_pairs(first: DataFrame, second: DataFrame, count: str, other: str) -> DataFrame:
    """(a, b, ``count``, ``other``): pairs that either signal has, a < b, whichever way round they are given, with 0 for the signal that lacks one."""
    turned = lambda rows, name: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(name)).groupBy("a", "b").agg(F.sum(name).alias(name))
    both = turned(first, count).join(turned(second, other), ["a", "b"], "full_outer")
    return both.select("a", "b", F.coalesce(count, F.lit(0)).alias(count), F.coalesce(other, F.lit(0)).alias(other))
