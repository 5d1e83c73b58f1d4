"""Invitations in messages: detection, verification against the message read again, and records that appear once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import lexicon as L
from ledgerline.functions import text as X


def company_of(sender: Column) -> Column:
    """The first label of the sender's domain with a capital; the sender itself without one, else Unknown."""
    domain = F.regexp_extract(F.lower(sender), r"@([a-z0-9.-]+)", 1)
    label = F.substring_index(domain, ".", 1)
    return F.when(domain != "", F.concat(F.upper(F.left(label, F.lit(1))), F.substring(label, 2, 1000))).otherwise(F.coalesce(F.when(F.trim(sender) != "", F.trim(sender)), F.lit("Unknown")))


def title_of(subject: Column, body: Column) -> Column:
    """The first title of 3 to 80 characters by either pattern, in the body before the subject."""
    tries = []
    for pattern in L.TITLES:
        for text in (body, subject):
            title = F.trim(F.regexp_extract(text, pattern, 1))
            tries.append(F.when(F.length(title).between(3, 80), title))
    return F.coalesce(*tries)


def quote_of(body: Column) -> Column:
    """The first line of the body with a phrase of invitations."""
    lines = F.filter(F.split(body, "\r\n|\r|\n"), lambda x: X.any_of(F.lower(x), L.INVITES) & (F.trim(x) != ""))
    return F.trim(F.get(lines, F.lit(0)))


def detected(messages: DataFrame) -> DataFrame:
    """Messages (message_id, subject, sender, body) that invite and don't refuse, with company, quote and title; a phrase in the subject alone is none."""
    text = F.lower(F.concat_ws(" ", "subject", "body"))
    rows = messages.where(X.any_of(text, L.INVITES) & ~X.any_of(text, L.REFUSALS))
    return rows.withColumns({"company": company_of(F.col("sender")), "quote": quote_of(F.col("body")), "title": title_of(F.col("subject"), F.col("body"))}).where("quote is not null")


def verified(invites: DataFrame, again: DataFrame) -> DataFrame:
    """``invites`` with problem: the first reason why the message read again (message_id, body) doesn't bear it out; null if it does."""
    read = again.select(F.col("message_id").alias("again_id"), F.col("body").alias("again_body"))
    rows = invites.join(read, F.col("message_id") == F.col("again_id"), "left")
    why = (
        F.when(F.coalesce(F.trim("message_id"), F.lit("")) == "", "no_message_id")
        .when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no_quote")
        .when(F.col("again_id").isNull(), "not_found")
        .when(~X.verbatim_in(F.col("quote"), F.col("again_body")), "quote_not_in_body")
    )
    return rows.withColumn("problem", why).drop("again_id", "again_body")


def scanned(messages: DataFrame, again: DataFrame, known: DataFrame) -> DataFrame:
    """One row: scanned, detected, verified, rejected and new counts; ``known`` has the message ids recorded before."""
    found = verified(detected(messages), again).join(known.select("message_id", F.lit(True).alias("old")), "message_id", "left")
    counted = found.agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(F.col("problem").isNull()).alias("verified"), F.count_if(F.col("problem").isNotNull()).alias("rejected"),
        F.count_if(F.col("problem").isNull() & F.col("old").isNull()).alias("new"),
    )
    return counted.withColumn("scanned", F.lit(messages.count()))


def with_applications(interviews: DataFrame, applications: DataFrame) -> DataFrame:
    """Interviews (company) with the last application (id, company) to the same company by compact name; null where there is none."""
    last = applications.groupBy(X.compact_key(F.col("company")).alias("k")).agg(F.max("id").alias("application")).where("k <> ''")
    return interviews.withColumn("k", X.compact_key(F.col("company"))).join(last, "k", "left").drop("k")
