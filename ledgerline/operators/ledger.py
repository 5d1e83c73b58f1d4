"""The manifest of a source universe, and the ledger that reconciles every object of it from raw text to elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators.entities import mentions
from ledgerline.operators.projects import match_terms
from ledgerline.operators.segments import reflowed

# fixed value: so many faults of a structure are told
MOST_FAULTS = 5
FLAGS = ["raw_captured", "hash_verified", "extraction_complete", "structure_complete", "provenance_complete"]


def split_repo_ref(system: Column, path: Column) -> Column:
    """repo and sha of ``repo@sha`` for systems of repositories; a ref without a sha is a repo, other systems have neither."""
    mine, at = F.startswith(system, F.lit("github")), F.locate("@", path)
    repo = F.when(mine, F.when(at > 0, F.substring(path, F.lit(1), at - 1)).otherwise(path))
    return F.struct(repo.alias("repository"), F.when(mine & (at > 0), F.substring(path, at + 1, F.length(path))).alias("commit_sha"))


def manifest(documents: DataFrame, projects: DataFrame, required: DataFrame) -> DataFrame:
    """A row per document: source_id, system, path, name, size_bytes, content_hash, repository, commit_sha, extraction_status, project_references (sorted).

    documents: source_id, system, path, title, raw, content_hash, status; raw is null where nothing was captured. A
    project (name, aliases) is referenced where one of its terms stands in the title, path or text; required
    names (name) are searched as they are, even if no project has them.
    """
    known = projects.select("name", match_terms(F.col("name"), F.col("aliases")).alias("terms"))
    extra = required.join(known.select(X.loose_key(F.col("name")).alias("k")), X.loose_key(F.col("name")) == F.col("k"), "left_anti").select("name", match_terms(F.col("name"), F.array().cast("array<string>")).alias("terms"))
    terms = known.unionByName(extra).select("name", F.explode("terms").alias("term"))
    places = [documents.select("source_id", X.loose_key(F.col(c)).alias("haystack")).where("haystack is not null") for c in ("title", "path", "raw")]
    found = mentions(places[0].unionByName(places[1]).unionByName(places[2]), terms.select("name", X.loose_key(F.col("term")).alias("term")).where("term <> ''"), "source_id", "haystack", "name", "term")
    listed = found.groupBy(F.col("document").alias("k")).agg(F.array_sort(F.collect_set("term")).alias("project_references"))
    rows = documents.join(listed, F.col("source_id") == F.col("k"), "left")
    status = F.when(F.col("raw").isNull(), "uncaptured").otherwise(F.coalesce("status", F.lit("captured")))
    return rows.select(
        "source_id", "system", "path", F.coalesce("title", "path").alias("name"), F.octet_length("raw").alias("size_bytes"), "content_hash", split_repo_ref(F.col("system"), F.col("path")).alias("r"),
        status.alias("extraction_status"), F.coalesce("project_references", F.array().cast("array<string>")).alias("project_references"),
    ).select("source_id", "system", "path", "name", "size_bytes", "content_hash", "r.*", "extraction_status", "project_references")


def required_present(entries: DataFrame, required: DataFrame) -> DataFrame:
    """(name, present): whether any document of the manifest refers to a required name, spelt alike or not."""
    seen = entries.select(F.explode("project_references").alias("n")).select(X.loose_key(F.col("n")).alias("k")).distinct()
    return required.join(seen, X.loose_key(F.col("name")) == F.col("k"), "left").select("name", F.col("k").isNotNull().alias("present"))


def reconciled(objects: DataFrame, faults: DataFrame, trees: DataFrame) -> DataFrame:
    """A ledger row per object: FLAGS, element_count, output_hash, failures (in order) and status (``ok`` or ``failed``).

    objects: source_id, raw (null: not captured), content_hash (SHA-256 of the raw text), status, location. faults of
    coverage: source_id, start, reason. trees: source_id, elements, output_hash. A structure is complete if it covers the text and,
    unless that is blank, has elements; only then does its hash count.
    """
    told = faults.groupBy(F.col("source_id").alias("f_")).agg(F.array_sort(F.collect_list(F.struct("start", "reason"))).alias("faults"))
    rows = objects.join(told, F.col("source_id") == F.col("f_"), "left").join(trees.select(F.col("source_id").alias("t_"), F.col("elements").cast("long").alias("n_"), F.col("output_hash").alias("hash_")), F.col("source_id") == F.col("t_"), "left")
    there, n = F.col("raw").isNotNull(), F.coalesce("n_", F.lit(0).cast("long"))
    listed = F.transform(F.slice(F.coalesce("faults", F.array().cast("array<struct<start: int, reason: string>>")), 1, MOST_FAULTS), lambda f: F.concat(F.lit("structure:"), f["reason"]))
    whole = there & F.col("faults").isNull()
    empty = whole & (n == 0) & (F.trim("raw") != "")
    rows = rows.withColumns({
        "raw_captured": there, "hash_verified": F.coalesce(there & (F.sha2("raw", 256) == F.col("content_hash")), F.lit(False)), "extraction_complete": there & F.coalesce(F.col("status") != "failed", F.lit(True)),
        "structure_complete": whole & ~F.coalesce(empty, F.lit(False)), "provenance_complete": there & F.col("location").isNotNull(), "element_count": n,
    })
    checks = [F.when(~there, "no_capture"), F.when(there & ~F.col("hash_verified"), "hash_mismatch"), F.when(there & ~F.col("extraction_complete"), "extraction_failed")]
    late = [F.when(empty, "no_elements"), F.when(there & ~F.col("provenance_complete"), "no_provenance")]
    failures = F.array_compact(F.concat(F.array(*checks), F.when(there, listed).otherwise(F.slice(listed, 1, 0)), F.array(*late)))
    rows = rows.withColumn("failures", failures)
    return rows.select("source_id", *FLAGS, "element_count", F.when(F.col("structure_complete"), F.col("hash_")).alias("output_hash"), "failures", F.when(F.size("failures") == 0, "ok").otherwise("failed").alias("status"))


def rollup(ledger: DataFrame) -> DataFrame:
    """One row: objects, failed, the percentage of objects with each of FLAGS (100 for none), and passed."""
    share = lambda c: F.coalesce(F.round(100.0 * F.avg(F.col(c).cast("int")), 3), F.lit(100.0)).alias(f"{c}_pct")
    return ledger.agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("status") != "ok").alias("failed"), *map(share, FLAGS), F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("passed"))


def recomputable(rows: DataFrame) -> DataFrame:
    """``rows`` (text, start, end, raw) with ``recomputes``: whether the span of the raw text, reflowed, or of the reflowed text is the text; without a span, whether the reflowed text holds it. White space doesn't count."""
    size = F.col("end") - F.col("start")
    cut = rows.withColumn("slice_", F.when(F.col("end") <= F.length("raw"), F.substring("raw", F.col("start") + 1, size)))
    cut = reflowed(reflowed(cut, "slice_", "slice_"), "raw", "normal_")
    target = X.squeezed(F.col("text"))
    of_raw = X.squeezed(F.col("slice_")) == target
    of_normal = (F.col("end") <= F.length("normal_")) & (X.squeezed(F.substring("normal_", F.col("start") + 1, size)) == target)
    ok = F.when(F.col("start").isNotNull(), F.coalesce(of_raw, F.lit(False)) | F.coalesce(of_normal, F.lit(False))).otherwise(F.contains(X.squeezed(F.col("normal_")), target))
    return cut.withColumn("recomputes", (target != "") & F.coalesce(ok, F.lit(False))).drop("slice_", "normal_")
