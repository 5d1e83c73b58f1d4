"""Reads of stored evidence, claims and applications: filters, orders and links, and small conversions of values.

Evidence: id, entity, element, seq, active, source_type, source_ref. Orders are column lists for ``orderBy``, so a read that
needs none doesn't sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import split_ref
from ledgerline.operators.edits import ATTESTED
from ledgerline.operators.order import indexed


def document_order() -> list[Column]:
    """Evidence on elements first, in order of these and of its sequence, then the rest by id."""
    return [F.col("element").isNull(), F.col("element"), F.col("seq").asc_nulls_first(), F.col("id")]


def render_order() -> list[Column]:
    return [F.col("sort_order"), F.col("id")]


def unassigned(evidence: DataFrame) -> DataFrame:
    """Evidence in use without an entity; what a person has said is none of it."""
    return evidence.where(F.col("entity").isNull() & F.col("active") & (F.col("source_type") != ATTESTED))


def assigned(evidence: DataFrame, entity) -> DataFrame:
    """Evidence in use of one entity; order by ``document_order``."""
    return evidence.where(F.col("active") & (F.col("entity") == entity))


def of_elements(evidence: DataFrame, elements: DataFrame) -> DataFrame:
    """Evidence in use on any of ``elements`` (element); none for none."""
    return evidence.where("active").join(elements.select("element").distinct(), "element", "left_semi")


def with_status(rows: DataFrame, status: str | None = None) -> DataFrame:
    """Rows of a status, or all."""
    return rows if status is None else rows.where(F.col("status") == status)


def of_confirmed(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims (entity) of confirmed entities (entity, status)."""
    return claims.join(entities.where("status = 'confirmed'").select("entity"), "entity", "left_semi")


def applications(rows: DataFrame, jobs: DataFrame, outreach: DataFrame) -> DataFrame:
    """Applications (application, job) with title and url of their job, and recipient and state of their outreach, at most one each (the smallest id); nulls where there is none."""
    first = outreach.withColumn("nth", F.row_number().over(W.partitionBy("application").orderBy("id"))).where("nth = 1")
    return rows.join(jobs.select("job", "title", "url"), "job", "left").join(first.select("application", "recipient", F.col("state").alias("outreach_state")), "application", "left")


def minted(rows: DataFrame, order: list[Column], name: str, start: int = 0, group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``name``: numbers in order, the first one after ``start``, within each group or over all rows; the latter by ranges, in no single task."""
    if group:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)) + start)
    placed = indexed(rows.withColumn("all_", F.lit(0)), "all_", order, name)
    return placed.drop("all_").withColumn(name, F.col(name) + (start + 1))


# --- values ----------------------------------------------------------------------


def evidence_url(source_type: Column, source_ref: Column) -> Column:
    """Where a person can read a piece of evidence: the whole document; null for what is local."""
    ref = split_ref(F.trim(source_ref))["base"]
    commit, pull = r"^(.+)@([^@]+)$", r"^(.+)#([0-9]+)$"
    return (
        F.when(ref == "", F.lit(None))
        .when(source_type == "github_readme", F.concat(F.lit("https://github.com/"), ref))
        .when((source_type == "github_commit") & ref.rlike(commit), F.concat(F.lit("https://github.com/"), F.regexp_extract(ref, commit, 1), F.lit("/commit/"), F.regexp_extract(ref, commit, 2)))
        .when((source_type == "github_pr") & ref.rlike(pull), F.concat(F.lit("https://github.com/"), F.regexp_extract(ref, pull, 1), F.lit("/pull/"), F.regexp_extract(ref, pull, 2)))
        .when(source_type == "drive", F.concat(F.lit("https://drive.google.com/open?id="), ref))
    )


def clamped(score: Column) -> Column:
    """A score in 0..1 with four decimals; null stays null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score.cast("double"), 4))))


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value.try_cast("bigint"))


def look_back(now: Column, hours: int) -> Column:
    """The begin of a window that ends ``now``."""
    return now - F.expr(f"INTERVAL {int(hours)} HOURS")


def percent_line(name: str, count: Column, rate: Column) -> Column:
    """``name=count (rate%)`` as people read it."""
    return F.concat(F.lit(f"{name}="), count.cast("string"), F.lit(" ("), F.format_number(F.bround(rate * 100), 0), F.lit("%)"))


MATERIALS = "struct<summary: string, highlights: array<string>, cover_letter: string, highlight_claim_ids: array<bigint>, highlight_refs: array<string>>"


def materials_of(text: Column) -> Column:
    """Stored materials read back from JSON; texts and lists that are missing are empty, JSON that is none gives null."""
    m = F.from_json(text, MATERIALS)
    empty = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c, kind: F.array_compact(F.coalesce(c, F.array().cast(kind)))
    return F.when(F.try_parse_json(text).isNotNull(), F.struct(empty(m["summary"]).alias("summary"), listed(m["highlights"], "array<string>").alias("highlights"), empty(m["cover_letter"]).alias("cover_letter"), listed(m["highlight_claim_ids"], "array<bigint>").alias("highlight_claim_ids"), listed(m["highlight_refs"], "array<string>").alias("highlight_refs")))
