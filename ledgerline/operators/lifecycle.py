"""Merges of a new generation of rows into an old one, keeping earlier human decisions. Every function is idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import normal_key


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: Column | None = None) -> DataFrame:
    """All keys of both; on a key of both the new row counts, unless ``keep`` (of the old row's columns) holds.

    Both sides have the same columns and each key once.
    """
    old = old.withColumn("old_kept", F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)).withColumn("in_old", F.lit(True))
    merged = old.alias("o").join(new.withColumn("in_new", F.lit(True)).alias("n"), key, "full_outer")
    use_old = F.col("in_new").isNull() | F.coalesce(F.col("old_kept"), F.lit(False))
    rest = [c for c in new.columns if c not in key]
    return merged.select(*key, *(F.when(use_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in rest))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def replace_partition(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` in place of every row of ``old`` that has one of its keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_unreviewed(old: DataFrame, new: DataFrame, reviewed: Column, fingerprint: list[str]) -> DataFrame:
    """Reviewed rows of ``old``, and rows of ``new`` whose fingerprint none of those has, each fingerprint once (smallest id)."""
    kept = old.where(reviewed)
    fresh = new.join(kept.select(*fingerprint).distinct(), fingerprint, "left_anti")
    first = F.row_number().over(W.partitionBy(*fingerprint).orderBy("id"))
    return kept.unionByName(fresh.withColumn("nth", first).where("nth = 1").drop("nth"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


def changed(rows: DataFrame, ledger: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Rows whose key and digest the ledger doesn't have: those left to do."""
    return rows.join(ledger.select(*key, digest).distinct(), [*key, digest], "left_anti")


def next_version(snapshots: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """``current`` with version: the latest one if its digest is unchanged, else one more; 1 for a new key."""
    last = latest(snapshots, [key], [F.desc("version")]).select(key, F.col(digest).alias("last_digest"), F.col("version").alias("last_version"))
    joined = current.join(last, key, "left")
    version = F.when(F.col("last_version").isNull(), 1).when(F.col("last_digest") == F.col(digest), F.col("last_version")).otherwise(F.col("last_version") + 1)
    return joined.select(*current.columns, version.alias("version"))


def capture_versions(versions: DataFrame, captured: DataFrame, doc: str, digest: str) -> DataFrame:
    """(doc, digest, is_active) of all versions ever seen; the captured one is active, and documents not captured stay as they were."""
    seen = versions.select(doc, digest, "is_active").join(captured.select(doc, F.col(digest).alias("now")), doc, "left")
    kept = seen.select(doc, digest, F.when(F.col("now").isNull(), F.col("is_active")).otherwise(F.col("now") == F.col(digest)).alias("is_active"))
    return insert_absent(kept, captured.select(doc, digest, F.lit(True).alias("is_active")), [doc, digest])


def plan_supersession(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, successor, match, pin, outcome) for active rows of ``existing`` (id, doc, body, is_active, pinned) that ``fresh`` (id, doc, body, pinned) lacks.

    The successor is the first fresh row of the document with the same text
    (exact), else the first that holds the text (broader) or is held by it
    (piece). A human pin moves to an exact successor or a piece that has no pin;
    of several pins on one successor the one of the smallest id moves and
    others conflict; a pin without a place to go is a warning.
    """
    stale = existing.where("is_active").join(fresh.select("id"), "id", "left_anti").select(F.col("id").alias("stale"), "doc", normal_key(F.col("body")).alias("was"), F.col("pinned").alias("pin"))
    now = fresh.select(F.col("id").alias("new"), "doc", normal_key(F.col("body")).alias("is"), F.col("pinned").alias("new_pin"))
    kind = (
        F.when(F.col("was") == F.col("is"), "exact")
        .when(F.contains("is", F.col("was")), "broader")
        .when((F.col("is") != "") & F.contains("was", F.col("is")), "piece")
    )
    matches = stale.where("was <> ''").join(now, "doc").withColumn("match", kind).where("match is not null")
    best = matches.groupBy("stale").agg(F.min(F.struct(F.when(F.col("match") == "exact", 0).otherwise(1).alias("late"), "new", "match", "new_pin")).alias("b"))
    plan = stale.join(best.withColumnRenamed("stale", "s"), F.col("stale") == F.col("s"), "left").select("stale", "pin", F.col("b.new").alias("successor"), F.col("b.match").alias("match"), F.col("b.new_pin").alias("new_pin"))
    can = F.col("pin").isNotNull() & F.col("match").isin("exact", "piece") & F.col("new_pin").isNull()
    moving = plan.where(can)
    won = moving.groupBy("successor").agg(F.min(F.struct("stale", "pin")).alias("w")).select(F.col("successor").alias("k"), F.col("w.stale").alias("winner"), F.col("w.pin").alias("kept_pin"))
    plan = plan.join(won, F.col("successor") == F.col("k"), "left")
    outcome = (
        F.when(F.col("pin").isNull(), "superseded")
        .when(F.col("successor").isNull(), "warn_no_successor")
        .when(F.col("match") == "broader", "warn_broader")
        .when(F.col("new_pin").isNotNull(), "kept_decision")
        .when(F.col("stale") == F.col("winner"), "migrated")
        .when(F.col("pin") == F.col("kept_pin"), "superseded")
        .otherwise("warn_conflict")
    )
    return plan.select(F.col("stale").alias("id"), "successor", "match", "pin", outcome.alias("outcome"))
