"""Two-stage matching: score all postings against a profile, keep a shortlist, rank it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import token_set, tokens

SHORTLIST, FINAL = 250, 10
#: A profile describes one person; more distinct tokens than this are refused.
PROFILE_TOKENS = 200_000


def profile_tokens(statements: DataFrame, text_col: str = "text") -> list[str]:
    """The distinct tokens of all statements of one profile, sorted; refused beyond PROFILE_TOKENS."""
    found = statements.select(F.explode(tokens(F.col(text_col))).alias("t")).distinct().limit(PROFILE_TOKENS + 1).collect()
    if len(found) > PROFILE_TOKENS:
        raise ValueError(f"a profile of over {PROFILE_TOKENS} tokens")
    return sorted(r["t"] for r in found)


def score_postings(postings: DataFrame, profile: list[str], title: Column, description: Column) -> DataFrame:
    """``postings`` with score and matched_terms.

    The score is the share of the posting's distinct tokens that the profile has,
    plus a tenth per such token in the title, 1 at most, to four decimals; 0
    for a posting without tokens.
    """
    # tokens are plain characters; as a literal list the profile is one hash set for all rows
    listed = ", ".join(f"'{t}'" for t in profile) or "NULL"
    scored = postings.withColumn("job_tokens", token_set(F.concat_ws(" ", title, description))).withColumn("title_tokens", token_set(title))
    scored = scored.withColumn("own_tokens", F.expr(f"filter(job_tokens, t -> coalesce(t IN ({listed}), false))"))
    scored = scored.withColumn("in_title", F.size(F.array_intersect("title_tokens", "own_tokens")))
    share = F.try_divide(F.size("own_tokens"), F.size("job_tokens"))
    # least() passes over nulls, so a posting without tokens is settled first
    score = F.least(F.lit(1.0), F.coalesce(F.round(share + 0.1 * F.coalesce("in_title", F.lit(0)), 4), F.lit(0.0)))
    return scored.withColumn("matched_terms", F.array_sort("own_tokens")).withColumn("score", score).drop("job_tokens", "title_tokens", "own_tokens", "in_title")


def shortlist(scored: DataFrame, id_col: str, size: int = SHORTLIST) -> DataFrame:
    """The best ``size`` by score, then id."""
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(size)


def rank(short: DataFrame, id_col: str, size: int = FINAL) -> DataFrame:
    """The best ``size`` of a shortlist with their ranks from 1 and a rationale."""
    best = shortlist(short, id_col, size)
    terms = F.slice("matched_terms", 1, 8)
    why = F.when(F.size(terms) > 0, F.concat(F.lit("Strong overlap on: "), F.array_join(terms, ", "))).otherwise("No strong keyword overlap with the profile.")
    # at most `size` rows reach this window
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc(id_col)))).withColumn("rationale", why)


def select_statements(statements: DataFrame, topics: DataFrame, topic_col: str, statement_col: str, most: int = 5, fallback: int = 3) -> DataFrame:
    """(topic, statement, overlap, place): the statements of each topic's group that share most tokens with it.

    ``topics`` has the topic id, group and topic_tokens (distinct); ``statements``
    the statement id, group and statement_tokens. Statements that share a token
    come first by number of shared tokens, then id, ``most`` of them; a topic
    without any such statement gets the first ``fallback`` of its group.
    """
    shared = (
        topics.select(topic_col, "group", F.explode("topic_tokens").alias("token"))
        .join(statements.select(statement_col, "group", F.explode("statement_tokens").alias("token")), ["group", "token"])
        .groupBy(topic_col, statement_col)
        .agg(F.count(F.lit(1)).alias("overlap"))
    )
    place = F.row_number().over(W.partitionBy(topic_col).orderBy(F.desc("overlap"), F.asc(statement_col)))
    best = shared.withColumn("place", place).where(F.col("place") <= most)
    first = statements.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(statement_col))).where(F.col("place") <= fallback)
    rest = topics.join(best.select(topic_col).distinct(), topic_col, "left_anti").join(first, "group").select(topic_col, statement_col, F.lit(0).cast("long").alias("overlap"), "place")
    return best.select(topic_col, statement_col, "overlap", "place").unionByName(rest)
