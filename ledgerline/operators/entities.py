"""Text shared between entities, assignment of chunks to entities, and groups of related statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import normal_key, token_set, tokens
from ledgerline.tables import materialize

MIN_SHARED_CHARS = 60


def entity_overlaps(chunks: DataFrame, entity_col: str, text_col: str, least_chars: int = MIN_SHARED_CHARS) -> DataFrame:
    """(entity_a, entity_b, shared): number of distinct texts of at least ``least_chars`` characters that two entities share, a < b.

    Texts are compared squeezed and in lower case. Texts with the same set of
    entities are counted before that set's pairs are formed, once per set.
    """
    texts = chunks.where(F.col(entity_col).isNotNull()).select(F.col(entity_col).alias("entity"), normal_key(F.col(text_col)).alias("text")).where(F.length("text") >= least_chars)
    sets = texts.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.array_sort(F.collect_set("entity")).alias("entities")).where(F.size("entities") > 1)
    sets = sets.groupBy("entities").agg(F.count(F.lit(1)).alias("n"))
    ends = sets.select("n", "entities", F.posexplode("entities").alias("at", "entity_a"))
    pairs = ends.select("n", "entity_a", F.explode(F.expr("slice(entities, at + 2, size(entities))")).alias("entity_b"))
    return pairs.groupBy("entity_a", "entity_b").agg(F.sum("n").alias("shared"))


def assign(chunks: DataFrame, profiles: DataFrame, chunk_col: str, tokens_col: str) -> DataFrame:
    """(chunk, entity, overlap): the one entity with most tokens in common; null on a tie or without any.

    ``profiles`` has entity and token, each pair once; ``chunks`` an array of distinct tokens.
    """
    shared = chunks.select(chunk_col, F.explode(tokens_col).alias("token")).join(profiles, "token").groupBy(chunk_col, "entity").agg(F.count(F.lit(1)).alias("overlap"))
    top = shared.groupBy(chunk_col).agg(F.max(F.struct("overlap", "entity")).alias("best"), F.max("overlap").alias("most"))
    ties = shared.join(top.select(F.col(chunk_col).alias("c"), "most"), (F.col(chunk_col) == F.col("c")) & (F.col("overlap") == F.col("most"))).groupBy("c").agg(F.count(F.lit(1)).alias("at_top"))
    found = top.join(ties, F.col(chunk_col) == F.col("c")).select(F.col("c").alias("chunk"), F.when(F.col("at_top") == 1, F.col("best.entity")).alias("entity"), "most")
    return chunks.select(chunk_col).join(found, F.col(chunk_col) == F.col("chunk"), "left").select(chunk_col, "entity", F.coalesce("most", F.lit(0)).alias("overlap"))


def combined_assignment(heading: Column, body: Column) -> Column:
    """A heading's pick outranks the body's."""
    return F.coalesce(heading, body)


def mentions(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_id: str, term_col: str) -> DataFrame:
    """(document, term), each pair once: terms that stand in documents as exact substrings. Blank terms stand in none.

    Words are parted by spaces and newlines. Documents and terms meet on one word
    of the term, the anchor: an inner word if there is one, which must be a whole
    word of the document, else the longer one of both ends, which ends or begins
    a word there, or the only word, which lies inside one. Pieces of words are
    looked up once per distinct word of all documents, and only in the lengths
    that anchors have. Each document's candidates then meet its text once.
    """
    words = F.split(F.col(term_col), "[ \n]")
    n = F.size(words)
    kind = lambda i: F.when(n == 1, "inside").when(i == 0, "end").when(i == n - 1, "start").otherwise("whole")
    ranked = F.transform(words, lambda w, i: F.struct((kind(i) != "whole").alias("outer"), (-F.length(w)).alias("short"), kind(i).alias("kind"), w.alias("piece")))
    best = F.array_min(ranked)
    anchors = terms.where(F.trim(F.regexp_replace(term_col, "\n", " ")) != "").select(F.col(term_id).alias("term"), F.col(term_col).alias("term_text"), best["kind"].alias("kind"), best["piece"].alias("piece"))

    lengths = {r["kind"]: sorted(r["n"]) for r in anchors.where("kind <> 'whole'").groupBy("kind").agg(F.collect_set(F.length("piece")).alias("n")).collect()}
    of = lambda k: F.filter(F.lit(lengths[k]), lambda m: m <= F.length("word"))
    named = lambda k, piece: F.struct(F.lit(k).alias("kind"), piece.alias("piece"))
    pieces = [F.array(named("whole", F.col("word")))]
    if "end" in lengths:
        pieces.append(F.transform(of("end"), lambda m: named("end", F.right("word", m))))
    if "start" in lengths:
        pieces.append(F.transform(of("start"), lambda m: named("start", F.left("word", m))))
    if "inside" in lengths:
        at = lambda m: F.sequence(F.lit(1), F.length("word") - m + 1)
        inner = F.transform(of("inside"), lambda m: F.transform(at(m), lambda i: F.substring("word", i, m)))
        pieces.append(F.transform(F.array_distinct(F.flatten(inner)), lambda p: named("inside", p)))  # strings are told apart by hashing, structs in pairs
    own = docs.select(F.col(id_col).alias("document"), F.explode(F.array_distinct(F.split(F.col(text_col), "[ \n]"))).alias("word"))
    hits = own.select("word").distinct().select("word", F.inline(F.concat(*pieces))).join(anchors, ["kind", "piece"]).select("word", F.struct("term", "term_text").alias("found"))

    wanted = own.join(hits, "word").groupBy("document").agg(F.collect_set("found").alias("wanted"))
    text = docs.select(F.col(id_col).alias("document"), F.col(text_col).alias("body"))
    held = text.join(wanted, "document").select("document", F.explode(F.filter("wanted", lambda t: F.contains("body", t["term_text"]))).alias("found"))
    return held.select("document", "found.term").distinct()


def similar_pairs(sets: DataFrame, id_col: str, set_col: str, least: float = 0.5) -> DataFrame:
    """(a, b, similarity), a < b: pairs of token sets with a Jaccard similarity of at least ``least``.

    Prefix filter: tokens are ordered from rare to common, and two sets this
    similar share a token among the first ``n - ceil(least * n) + 1`` of each.
    """
    each = sets.where(F.size(set_col) > 0).select(F.col(id_col).alias("id"), F.explode(set_col).alias("token"), F.size(set_col).alias("n"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(W.partitionBy("id").orderBy("held", "token"))
    prefix = each.join(counts, "token").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "token", "n")
    other = prefix.select(F.col("id").alias("other"), "token", F.col("n").alias("m"))
    near = prefix.join(other, "token").where((F.col("id") < F.col("other")) & (F.least("n", "m") >= least * F.greatest("n", "m"))).select("id", "other").distinct()
    full = sets.select(F.col(id_col).alias("k"), F.col(set_col).alias("s"))
    both = near.join(full.withColumnsRenamed({"k": "id", "s": "x"}), "id").join(full.withColumnsRenamed({"k": "other", "s": "y"}), "other")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("similarity", F.round(shared / (F.size("x") + F.size("y") - shared), 6)).where(shared >= least * (F.size("x") + F.size("y") - shared)).select(F.col("id").alias("a"), F.col("other").alias("b"), "similarity")


def profile_of(chunks: DataFrame, entity_col: str, text_col: str) -> DataFrame:
    """(entity, token), each pair once."""
    return chunks.select(F.col(entity_col).alias("entity"), F.explode(token_set(F.col(text_col))).alias("token")).distinct()


def contained(texts: DataFrame, group: list[str], id_col: str, text_col: str) -> DataFrame:
    """(group columns, inner, outer): ids of texts of one group of which the outer one contains the other inner one, and they share a token.

    A token between the first and the last of the inner text stands as a token in the outer one too, so candidates meet on the
    one of these that fewest texts of the group have; texts without such a token meet on any of theirs. Texts are
    joined to distinct candidates only.
    """
    rows = texts.select(*group, F.col(id_col).alias("inner"), tokens(F.col(text_col)).alias("tokens_"))
    ends = materialize(rows.select(*group, "inner", F.explode(F.array_distinct("tokens_")).alias("token")))
    held = ends.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = rows.select(*group, "inner", F.array_distinct(F.slice("tokens_", 2, F.greatest(F.size("tokens_") - 2, F.lit(0)))).alias("own"))
    anchors = inside.select(*group, "inner", F.explode("own").alias("token")).join(held, [*group, "token"], "left")
    rarest = anchors.groupBy(*group, "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "token")).alias("a")).select(*group, "inner", F.col("a.token").alias("token"))
    loose = inside.where(F.size("own") == 0).select(*group, "inner").join(ends, [*group, "inner"])
    met = rarest.unionByName(loose.select(*rarest.columns)).join(held.drop("n"), [*group, "token"], "left_semi").join(ends.withColumnRenamed("inner", "outer"), [*group, "token"])
    pairs = met.where("inner <> outer").select(*group, "inner", "outer").distinct()
    whole = lambda name: texts.select(*group, F.col(id_col).alias(name), F.col(text_col).alias(f"{name}_text"))
    both = pairs.join(whole("inner"), [*group, "inner"]).join(whole("outer"), [*group, "outer"])
    return both.where(F.contains("outer_text", F.col("inner_text"))).select(*group, "inner", "outer")


def _conflicting(quotes: DataFrame, text_col: str, signature: Column) -> DataFrame:
    """(signature, wording, n): wordings (normal texts, of n quotes) that are related to another one of their signature.

    Two are related when one contains the other and they share a token, or when half of their tokens are the same: found by
    ``contained``, and by ``similar_pairs`` on tokens that carry the signature, so texts meet on rare tokens only.
    """
    rows = quotes.select(normal_key(F.col(text_col)).alias("wording"), token_set(F.col(text_col)).alias("own"), signature.alias("signature")).where("signature <> ''")
    wordings = materialize(rows.groupBy("signature", "wording").agg(F.first("own").alias("own"), F.count(F.lit(1)).alias("n")).withColumn("w", F.md5(F.concat_ws("\n", "signature", "wording"))))
    alike = similar_pairs(wordings.select("w", F.transform("own", lambda t: F.concat("signature", F.lit("\n"), t)).alias("own")), "w", "own")
    within = contained(wordings, ["signature"], "w", "wording")
    near = alike.select(F.col("a").alias("w")).union(alike.select("b")).union(within.select("inner")).union(within.select("outer")).distinct()
    return wordings.join(near, "w", "left_semi").select("signature", "wording", "n")


def metric_conflicts(quotes: DataFrame, id_col: str, text_col: str, signature: Column) -> DataFrame:
    """(signature, quotes, wordings) where quotes carry the same numbers in different words of which some are related."""
    return _conflicting(quotes, text_col, signature).groupBy("signature").agg(F.sum("n").alias("quotes"), F.count(F.lit(1)).alias("wordings"))


def ordered_conflicts(quotes: DataFrame, id_col: str, text_col: str, date_col: str, signature: Column) -> DataFrame:
    """(signature, place, id): the quotes of every conflict, latest first, those without a date last, then by id."""
    rows = quotes.select(F.col(id_col).alias("id"), F.col(date_col).alias("at"), normal_key(F.col(text_col)).alias("wording"), signature.alias("signature"))
    found = rows.join(_conflicting(quotes, text_col, signature), ["signature", "wording"], "left_semi")
    return found.select("signature", F.row_number().over(W.partitionBy("signature").orderBy(F.desc_nulls_last("at"), "id")).alias("place"), "id")
