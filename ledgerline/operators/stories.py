"""Stories from claims: what is chosen for each entity, whether it is ready, and which problem a claim belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators.entities import contained
from ledgerline.operators.graph import connected_components
from ledgerline.tables import materialize

MAX_ACTIONS = 5


def leverage(result_kind: Column, verified: Column, attested: Column, problem: Column) -> Column:
    """4 for a verified number, 3 for another result, 2 for a stated problem, 1 otherwise."""
    return F.when((result_kind == "quantified") & verified, 4).when((result_kind != "missing") | attested, 3).when(F.coalesce(F.trim(problem), F.lit("")) != "", 2).otherwise(1)


def ranked(claims: DataFrame, relevance: Column | None = None) -> DataFrame:
    """``claims`` with place: per entity by relevance, leverage, no flags, number of links, recency (none last), length of the action, id."""
    key = [F.desc(relevance)] if relevance is not None else []
    key += [F.desc("leverage"), F.when(F.size("flags") > 0, 1).otherwise(0), F.desc("links"), F.desc_nulls_last("at"), F.length(X.squeezed(F.col("action"))), F.col("id")]
    return claims.withColumn("place", F.row_number().over(W.partitionBy("entity").orderBy(*key)))


def first_of(rows: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """The first row by place of each entity and key, at most ``most`` of them per entity."""
    once = rows.withColumn("k", key).where("k <> ''").withColumn("nth", F.row_number().over(W.partitionBy("entity", "k").orderBy("place"))).where("nth = 1")
    once = once.withColumn("chosen", F.row_number().over(W.partitionBy("entity").orderBy("place")))
    return (once if most is None else once.where(F.col("chosen") <= most)).drop("nth", "k")


def content(claims: DataFrame) -> DataFrame:
    """(entity, problem, problem_refs, actions, results): verbatim texts of the best claims; nothing is composed.

    Needs id, entity, status, action, problem, cost_dimension, inefficiency,
    outcome, result_kind, leverage, flags, links and at. Rejected claims feed
    nothing. The problem is the first that names a pain point and passes every
    test; equal actions and outcomes count once, five actions at most.
    """
    live = ranked(claims.where("status <> 'rejected' and entity is not null"))
    pain = live.where((F.col("cost_dimension").isNotNull() | F.col("inefficiency").isNotNull()) & (F.size(X.problem_reasons(F.col("problem"))) == 0))
    problem = pain.groupBy("entity").agg(F.min_by("problem", "place").alias("problem"))
    refs = live.join(problem.withColumnRenamed("problem", "chosen"), "entity").where(X.normal_key(F.col("problem")) == X.normal_key(F.col("chosen")))
    refs = refs.groupBy("entity").agg(F.array_sort(F.collect_list("id")).alias("problem_refs"))
    listed = lambda rows, text: rows.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", F.col(text).alias("text"), "id"))).alias("x"))
    actions = listed(first_of(live, X.normal_key(F.col("action")), MAX_ACTIONS), "action").select("entity", F.col("x.text").alias("actions"))
    results = listed(first_of(live.where("result_kind <> 'missing'"), X.normal_key(F.col("outcome"))), "outcome").select("entity", F.col("x.text").alias("results"))
    entities = claims.where("entity is not null").select("entity").distinct()
    out = entities.join(problem, "entity", "left").join(refs, "entity", "left").join(actions, "entity", "left").join(results, "entity", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"actions": F.coalesce("actions", none), "results": F.coalesce("results", none)})


def readiness(stories: DataFrame) -> DataFrame:
    """``stories`` (content, attested_problem, attested_result as booleans) with problem_state, result_state, missing, ready and questions."""
    problem = F.when(F.col("attested_problem"), "user_attested").when(F.col("problem").isNotNull(), "evidenced").otherwise("missing")
    result = F.when(F.size("results") > 0, "evidenced").when(F.col("attested_result"), "user_attested").otherwise("missing")
    rows = stories.withColumns({"problem_state": problem, "result_state": result})
    missing = F.array_compact(F.array(F.when(F.col("problem_state") == "missing", "problem"), F.when(F.size("actions") == 0, "actions"), F.when(F.col("result_state") == "missing", "result")))
    rows = rows.withColumn("missing", missing)
    coupled = addresses(F.col("problem"), F.col("results"))
    asked = F.array_compact(F.concat(F.transform("missing", lambda m: F.concat(F.lit("missing_"), m)), F.array(F.when(F.col("problem").isNotNull() & (F.size("results") > 0) & ~coupled, "coupling_mismatch"))))
    return rows.withColumns({"ready": F.size("missing") == 0, "questions": asked})


def addresses(problem: Column, results: Column) -> Column:
    """Whether any result shares a tag or two tokens with the problem; true where there is nothing to compare."""
    tags, tokens = X.pain_tags(problem), X.token_set(problem)
    near = F.exists(results, lambda r: F.arrays_overlap(X.pain_tags(r), tags) | (F.size(F.array_intersect(X.token_set(r), tokens)) >= 2))
    return F.coalesce(near, F.lit(False)) | problem.isNull() | (F.size(results) == 0)


def demoted(drafts: DataFrame, group: list[str], span: str, order: list[str]) -> DataFrame:
    """``drafts`` with duplicate: true where an earlier draft of the group has the span. A draft has one span at most."""
    nth = F.row_number().over(W.partitionBy(*group, span).orderBy(*order))
    return drafts.withColumn("duplicate", F.col(span).isNotNull() & (nth > 1))


def problem_groups(problems: DataFrame) -> DataFrame:
    """(entity, key, space): problems of one entity (entity, key: distinct normal texts) that are related, transitively, share a space.

    Two are related if one contains the other and they share a token, or if they share a tag and two tokens. All texts with
    a tag and the same two tokens are related to one another, so each is linked to the first of them only; a text
    of n tokens has about n²/2 pairs. For containment see ``entities.contained``.
    """
    rows = materialize(problems.select("entity", "key", F.md5("key").alias("n"), X.pain_tags(F.col("key")).alias("tags"), F.array_sort(X.token_set(F.col("key"))).alias("own")))
    later = F.transform("own", lambda t, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda u: F.concat_ws(" ", t, u)))
    pairs = rows.where(F.size("tags") > 0).select("entity", "n", "tags", F.explode(F.flatten(later)).alias("pair")).select("entity", "n", "pair", F.explode("tags").alias("tag"))
    first = pairs.groupBy("entity", "tag", "pair").agg(F.min("n").alias("first"), F.max("n").alias("last")).where("first < last").drop("last")
    alike = pairs.join(first, ["entity", "tag", "pair"]).where("n <> first").select("entity", F.col("n").alias("a"), F.col("first").alias("b")).distinct()
    within = contained(rows, ["entity"], "n", "key").select("entity", F.col("inner").alias("a"), F.col("outer").alias("b"))
    node = lambda c: F.struct("entity", F.col(c).alias("n"))
    parts = connected_components(alike.unionByName(within).select(node("a").alias("a"), node("b").alias("b"))).select("node.entity", "node.n", F.col("component.n").alias("part"))
    placed = rows.select("entity", "key", "n").join(parts, ["entity", "n"], "left").withColumn("part", F.coalesce("part", "n"))
    names = placed.groupBy("entity", "part").agg(F.min("key").alias("name"))
    return placed.join(names, ["entity", "part"]).select("entity", "key", X.short_id("ps", F.col("name")).alias("space"))


def attach(claims: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, space) for claims (id, entity, evidence) without a problem: the one space whose seeds (entity, space, evidence) cite the same evidence; none if there are several."""
    hits = claims.select("id", "entity", F.explode("evidence").alias("e")).join(seeds.select("entity", "space", F.explode("evidence").alias("e")).distinct(), ["entity", "e"])
    return hits.groupBy("id").agg(F.count_distinct("space").alias("n"), F.min("space").alias("space")).where("n = 1").select("id", "space")


def units(members: DataFrame, live: DataFrame, leftover: str = "leftover") -> DataFrame:
    """(entity, id, unit): live claims (entity, id) by space; the uncovered ones of an entity join its only space, or else are left over."""
    spaces = members.groupBy("entity").agg(F.count_distinct("space").alias("n"), F.min("space").alias("only"))
    rows = live.join(members.select("id", "space"), "id", "left").join(spaces, "entity", "left")
    return rows.select("entity", "id", F.coalesce("space", F.when(F.col("n") == 1, F.col("only")), F.lit(leftover)).alias("unit"))


def home_space(cited: DataFrame) -> DataFrame:
    """(story, home): a story's own space if it cites it, else the space of most cited claims, ties by the greatest id. Rows: story, own, space, id."""
    counted = cited.groupBy("story", "space").agg(F.count_distinct("id").alias("n"), F.max(F.col("space") == F.col("own")).alias("is_own"))
    return counted.groupBy("story").agg(F.max(F.struct("is_own", "n", "space")).alias("top")).select("story", F.col("top.space").alias("home"))


def cross_space(cited: DataFrame) -> DataFrame:
    """(story, id): claims that a story cites outside its home space."""
    return cited.join(home_space(cited), "story").where("space <> home").select("story", "id").distinct()


def sanitized(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(key, group_no): proposed groups (key, group_no, place) of known keys (key, place); unknown keys go, the first membership counts, and omitted keys are groups of their own."""
    first = groups.join(known.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("group_no", "place")).alias("f")).select("key", F.col("f.group_no").alias("group_no"))
    last = groups.agg(F.coalesce(F.max("group_no"), F.lit(-1)).alias("n")).first()["n"]
    rest = known.join(first, "key", "left_anti").select("key", (F.lit(last + 1) + F.col("place")).alias("group_no"))
    return first.unionByName(rest)


def bullets(selection: DataFrame) -> DataFrame:
    """``selection`` (action, result, problem_space, action_space, result_space, evidence) with violations, and bullet where there are none.

    A missing result stops at once; otherwise spaces must agree and every number must stand in the evidence.
    """
    text = X.bullet(F.col("action"), F.regexp_replace(F.trim("result"), r"[.]+$", ""))
    loose = F.transform(X.unsupported_numbers(text, F.col("evidence")), lambda n: F.concat(F.lit("unsupported_number:"), n))
    astray = F.array_compact(F.array(F.when((F.col("problem_space") != F.col("action_space")) | (F.col("problem_space") != F.col("result_space")), "space_mismatch")))
    found = F.when(F.coalesce(F.trim("result"), F.lit("")) == "", F.array(F.lit("result_missing"))).otherwise(F.concat(astray, loose))
    rows = selection.withColumn("violations", found)
    return rows.withColumn("bullet", F.when(F.size("violations") == 0, text))
