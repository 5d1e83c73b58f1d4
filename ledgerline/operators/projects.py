"""Rosters of entities: proposals, names and aliases, merges, and reconciliation with an expected list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import text as X


def name_variants(name: Column) -> Column:
    """A name as it is, with spaces, and with hyphens, each once."""
    flat = X.squeezed(name)
    spaced = X.squeezed(F.regexp_replace(flat, "[_-]", " "))
    return F.filter(F.array_distinct(F.array(flat, spaced, F.regexp_replace(spaced, " ", "-"))), lambda v: v != "")


def match_terms(name: Column, aliases: Column) -> Column:
    """Names that point to an entity in a text: its own, its aliases, and the last part of a path of four characters or more."""
    tail = F.substring_index(name, "/", -1)
    return F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.length(tail) >= 4, tail)))))


def named(entities: DataFrame) -> DataFrame:
    """(id, key) for the name and every alias."""
    return entities.select("id", F.explode(F.transform(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))), X.normal_key)).alias("key")).distinct()


def insert_or_match(entities: DataFrame, proposed: DataFrame) -> DataFrame:
    """(name, entity): proposals with the smallest known id that shares a name or alias in either direction; null for new ones."""
    own = proposed.select("name", "aliases", F.col("name").alias("id"))
    hits = named(own).withColumnRenamed("id", "proposal").join(named(entities), "key").groupBy("proposal").agg(F.min("id").alias("entity"))
    return proposed.select("name").join(hits, F.col("name") == F.col("proposal"), "left").select("name", "entity")


def proposals(sources: DataFrame) -> DataFrame:
    """One proposal per source title (source_ref, source_type, title, place): the first counts, commits propose nothing, blank titles neither."""
    rows = sources.where((F.col("source_type") != "commit") & (F.trim("title") != "")).withColumn("nth", F.row_number().over(W.partitionBy(F.lower("title")).orderBy("place"))).where("nth = 1")
    readme = F.col("source_type") == "readme"
    return rows.select(F.col("title").alias("name"), F.when(readme, "project").otherwise("employer_role").alias("kind"), F.when(readme, F.array("source_ref")).otherwise(F.array().cast("array<string>")).alias("aliases"), "source_ref")


def renamed(entities: DataFrame, names: DataFrame) -> DataFrame:
    """``entities`` with new names (id, new_name); an old name stays as an alias."""
    rows = entities.join(names, "id", "left")
    aliases = F.when(F.col("new_name").isNull() | (F.col("new_name") == F.col("name")), F.col("aliases")).otherwise(F.array_remove(F.array_distinct(F.concat("aliases", F.array("name"))), F.col("new_name")))
    return rows.select("id", F.coalesce("new_name", "name").alias("name"), aliases.alias("aliases"), *(c for c in entities.columns if c not in ("id", "name", "aliases")))


def merged(entities: DataFrame, owned: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and owned rows (entity) after merges (source, target): owned rows move, names become aliases of the target, the source is marked merged."""
    moved = owned.join(merges, F.col("entity") == F.col("source"), "left").withColumn("entity", F.coalesce("target", "entity")).drop("source", "target")
    names = entities.join(merges, F.col("id") == F.col("source")).select("target", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    gained = names.groupBy(F.col("target").alias("t")).agg(F.array_sort(F.collect_set("alias")).alias("gained"))
    out = entities.join(gained, F.col("id") == F.col("t"), "left").join(merges.select(F.col("source").alias("s")), F.col("id") == F.col("s"), "left")
    aliases = F.array_remove(F.array_distinct(F.concat("aliases", F.coalesce("gained", F.array().cast("array<string>")))), F.col("name"))
    return out.select("id", "name", aliases.alias("aliases"), F.when(F.col("s").isNotNull(), "merged").otherwise(F.col("status")).alias("status")), moved


def pinned(rows: DataFrame, machine: Column) -> DataFrame:
    """``rows`` (entity, method) with a machine's assignment, which never replaces a human's."""
    human = F.col("method") == "human"
    return rows.withColumns({"entity": F.when(human, F.col("entity")).otherwise(machine), "method": F.when(human, "human").otherwise("machine")})


def reconciled(expected: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """(expected, status, entity): detected if a variant names a known entity, present_in_source if one stands in a text, else missing. Expected names are few."""
    variants = expected.select("expected", F.explode(name_variants(F.col("expected"))).alias("v")).withColumn("key", X.normal_key(F.col("v")))
    known = variants.join(named(entities), "key").groupBy("expected").agg(F.min("id").alias("entity"))
    names = [r["expected"] for r in expected.select("expected").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("over 10,000 expected names")
    by_key = {r["key"]: r["expected"] for r in variants.select("key", "expected").collect()}
    body = X.normal_key(F.col("text"))
    hits = texts.select(F.explode(F.filter(F.lit(sorted(by_key)), lambda k: F.contains(body, k))).alias("key")) if by_key else variants.select("key").limit(0)
    found = variants.join(hits.distinct(), "key", "left_semi").select("expected").distinct().withColumn("seen", F.lit(True))
    rows = expected.join(known, "expected", "left").join(found, "expected", "left")
    return rows.select("expected", F.when(F.col("entity").isNotNull(), "detected").when(F.col("seen"), "present_in_source").otherwise("missing").alias("status"), "entity")
