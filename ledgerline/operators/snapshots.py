"""Nested snapshots of stories, digests that ignore the order of input, and the way back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import text as X

# fixed values: sections in the order of a resume, and separators of fingerprints
SECTIONS = ["professional_experience", "projects_hackathons"]
UNIT, RECORD = "\x1f", "\x1e"
_PART = ["place", "component_id", "text", "claim_ids", "outcome_quote", "evidence_text", "attested"]


# --- canonical values and digests ------------------------------------------------


def _arranged(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(_arranged(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _arranged(v, kind.elementType))
    if isinstance(kind, T.MapType):
        pair = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.transform(F.array_sort(F.map_entries(value)) if isinstance(kind.valueType, T.AtomicType) else F.array_sort(F.map_entries(value), _by_key), lambda e: _arranged(e, pair))
    return value


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def canonical(value: Column, kind: T.DataType) -> Column:
    """A nested value as JSON with fields in order of their names, map entries in order of their keys, and nulls written out."""
    return F.get_json_object(F.to_json(F.struct(_arranged(value, kind).alias("v")), {"ignoreNullFields": "false"}), "$.v") if isinstance(kind, T.AtomicType) else F.to_json(_arranged(value, kind), {"ignoreNullFields": "false"})


def digest(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical(value, kind), 256)


def set_fingerprint(texts: Column, version: str = "") -> Column:
    """Of an array of texts as a set: order, repeats, case and white space don't count, blank ones are none."""
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(texts, X.normal_key), lambda t: t != "")))
    return F.sha2(F.array_join(F.concat(F.array(F.lit(version)), keys), RECORD), 256)


def unit_fingerprints(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(unit, fingerprint) of synthesis units: claims (unit, id, status, problem, action, result, flags) and evidence (unit, source_type, source_ref, text), in any order."""
    none = F.lit("")
    line = F.concat_ws(UNIT, F.col("id").cast("string"), "status", F.coalesce("problem", none), F.coalesce("action", none), F.coalesce("result", none), F.array_join("flags", ","))
    told = claims.groupBy("unit").agg(F.array_sort(F.collect_list(line)).alias("claims"))
    shown = evidence.groupBy("unit").agg(F.array_sort(F.collect_list(F.concat_ws(UNIT, "source_type", "source_ref", F.coalesce("text", none)))).alias("evidence"))
    empty = F.array().cast("array<string>")
    parts = F.concat(F.array(F.col("unit").cast("string")), F.coalesce("claims", empty), F.array(F.lit("--")), F.coalesce("evidence", empty))
    return told.join(shown, "unit", "full_outer").select("unit", F.sha2(F.array_join(parts, RECORD), 256).alias("fingerprint"))


def tree_digests(elements: DataFrame, key: str) -> DataFrame:
    """(key, elements, output_hash) of element trees (key, seq, kind, level, parent, start, end, body): order, types, links, spans and texts count."""
    none = F.lit("None")
    shown = [F.col("seq").cast("string"), F.col("kind"), F.coalesce(F.col("level").cast("string"), none), F.coalesce(F.col("parent").cast("string"), none), F.col("start").cast("string"), F.col("end").cast("string"), F.sha2("body", 256)]
    lines = elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("|", *shown).alias("line")))).alias("x"))
    return lines.select(key, F.size("x").cast("long").alias("elements"), F.sha2(F.array_join("x.line", "\n"), 256).alias("output_hash"))


# --- snapshots -------------------------------------------------------------------


def assemble(stories: DataFrame, components: DataFrame) -> DataFrame:
    """(owner, sections): everything an owner shows, nested and sorted at every level.

    stories: owner, section, sort_order, entity, story, name, subtitle, dates. components: story, kind and the
    columns of _PART. Entries of a section are in order of sort_order, entity and story, parts in order of place and id;
    bullets are the texts of actions and results as sentences. A section without entries is an empty array; stories
    whose section is none of SECTIONS are left out.
    """
    part = F.struct(*_PART)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, part)))
    parts = components.groupBy("story").agg(F.get(of("problem"), F.lit(0)).alias("problem"), of("action").alias("actions"), of("result").alias("results"))
    sentence = lambda p: F.struct(X.terminated(F.trim(p["text"])).alias("text"), p["component_id"].alias("component_id"), p["claim_ids"].alias("claim_ids"))
    parts = parts.withColumn("bullets", F.transform(F.concat("actions", "results"), sentence))
    entry = F.struct("sort_order", "entity", "story", "name", "subtitle", "dates", "problem", "actions", "results", "bullets")
    rows = stories.join(parts, "story").where(F.col("section").isin(SECTIONS)).groupBy("owner", "section").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    named = rows.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("section", "entries"))).alias("m"))
    kind = rows.schema["entries"].dataType
    return named.select("owner", F.array(*(F.struct(F.lit(s).alias("section"), F.coalesce(F.col("m")[s], F.array().cast(kind)).alias("entries")) for s in SECTIONS)).alias("sections"))


def with_digest(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("digest", digest(F.col("sections"), snapshots.schema["sections"].dataType))


def _entries(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("owner", F.explode("sections").alias("s")).select("owner", "s.section", F.explode("s.entries").alias("e"))


def stories_of(snapshots: DataFrame) -> DataFrame:
    """The stories that snapshots were assembled from."""
    return _entries(snapshots).select("owner", "section", *(f"e.{c}" for c in ("sort_order", "entity", "story", "name", "subtitle", "dates")))


def components_of(snapshots: DataFrame) -> DataFrame:
    """The components that snapshots were assembled from."""
    tagged = lambda parts, kind: F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))
    problem = F.when(F.col("e.problem").isNotNull(), F.array("e.problem")).otherwise(F.slice("e.actions", 1, 0))
    listed = F.concat(tagged(problem, "problem"), tagged(F.col("e.actions"), "action"), tagged(F.col("e.results"), "result"))
    return _entries(snapshots).select(F.col("e.story").alias("story"), F.explode(listed).alias("x")).select("story", "x.kind", "x.p.*")


def claims_of(snapshots: DataFrame) -> DataFrame:
    """(owner, action, problem, result, source_ref, evidence_text): a row for each action alone, and one for each result with the story's first action and both their evidence."""
    e = _entries(snapshots).where(F.size("e.actions") > 0).select("owner", "e.*").withColumn("lead", F.get("actions", F.lit(0)))
    ref = lambda p: F.concat(F.lit("story:"), F.col("story").cast("string"), F.lit(":"), p["component_id"])
    none = F.lit(None).cast("string")
    alone = F.transform("actions", lambda p: F.struct(p["text"].alias("action"), none.alias("result"), ref(p).alias("source_ref"), F.coalesce(p["evidence_text"], F.lit("")).alias("evidence_text")))
    both = lambda p: F.array_join(F.filter(F.array(F.col("lead.evidence_text"), p["evidence_text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    paired = F.transform("results", lambda p: F.struct(F.col("lead.text").alias("action"), p["text"].alias("result"), ref(p).alias("source_ref"), both(p).alias("evidence_text")))
    rows = e.select("owner", F.nullif(F.col("problem.text"), F.lit("")).alias("problem"), F.explode(F.concat(alone, paired)).alias("c"))
    return rows.select("owner", "c.action", "problem", "c.result", "c.source_ref", "c.evidence_text")
