"""State machines as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.lexicon import NOTE_REQUIRED, TRANSITIONS


def edges(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """(kind, from_state, to_state) of all legal steps, or of one kind."""
    rows = [(k, a, b) for k, steps in TRANSITIONS.items() for a, b in steps if kind in (None, k)]
    return spark.createDataFrame(rows, "kind string, from_state string, to_state string")


def illegal_steps(log: DataFrame, legal: DataFrame, key: list[str], order: list[str], state_col: str) -> DataFrame:
    """The steps of a log, in order per key, that no edge of ``legal`` allows; a state's first appearance is no step and staying is none."""
    steps = log.withColumn("from_state", F.lag(state_col).over(W.partitionBy(*key).orderBy(*order))).withColumn("to_state", F.col(state_col))
    steps = steps.where("from_state is not null and from_state <> to_state")
    return steps.join(legal.select("from_state", "to_state").distinct(), ["from_state", "to_state"], "left_anti")


def allowed(legal: DataFrame) -> DataFrame:
    """(state, next_states): what each state may become, sorted; an empty array for terminal ones."""
    states = legal.select(F.col("from_state").alias("state")).union(legal.select("to_state")).distinct()
    steps = legal.groupBy(F.col("from_state").alias("state")).agg(F.array_sort(F.collect_set("to_state")).alias("next_states"))
    return states.join(steps, "state", "left").withColumn("next_states", F.coalesce("next_states", F.array().cast("array<string>")))


def apply_steps(rows: DataFrame, requests: DataFrame, key: str, kind: str) -> DataFrame:
    """``rows`` with requested steps applied where they are legal; ``refused`` says why one was not.

    ``requests`` has the key, to_state, at and note, one per key. Rejections and exclusions need a note.
    """
    legal = edges(rows.sparkSession, kind).select(F.col("from_state").alias("state"), F.col("to_state").alias("ok"))
    asked = rows.join(requests.select(F.col(key).alias("k"), "to_state", "at", "note"), F.col(key) == F.col("k"), "left")
    asked = asked.join(F.broadcast(legal), (asked["state"] == legal["state"]) & (F.col("to_state") == F.col("ok")), "left").drop(legal["state"])
    needs = F.col("to_state").isin([s for k, s in NOTE_REQUIRED if k == kind]) & (F.coalesce(F.trim("note"), F.lit("")) == "")
    refused = F.when(F.col("to_state").isNull(), F.lit(None)).when(F.col("ok").isNull(), "illegal").when(needs, "note_required")
    done = F.col("ok").isNotNull() & refused.isNull()
    own = [c for c in rows.columns if c not in ("state", "changed_at", "note")]
    return asked.select(*own, F.when(done, F.col("to_state")).otherwise(F.col("state")).alias("state"), F.when(done, F.col("at")).alias("changed_at"), refused.alias("refused"))
