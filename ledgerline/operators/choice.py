"""Choices in which an earlier row decides over later ones, without walking the rows in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.tables import materialize, parts

# fixed value: the flag of a draft that has lost its result to an earlier one with the same span
DUPLICATE_OUTCOME = "duplicate_outcome_span"

#: Groups of at most so many spans are walked as one row; larger ones take rounds.
WALKED = 1000


def first_independent(drafts: DataFrame, group: list[str], place: str, spans: str, max_rounds: int = 1000) -> tuple[DataFrame, int]:
    """``drafts`` with ``kept``, and the number of rounds that took.

    In order of ``place`` within a group, a draft is kept if no kept draft before it holds one of its
    ``spans`` (an array; nulls and repeats don't count); a draft that isn't kept holds none. Every round keeps
    the drafts that come first at each of their spans among those not yet decided, and drops those that meet
    one just kept. Rows of a span meet in partial minima, never in pairs. The number of rounds is that of the longest
    chain in which each draft waits for the one before, about the logarithm of the drafts for
    conflicts without order; ``place`` must be given and differ within a group.
    """
    drafts = materialize(drafts)
    node = [*group, place]
    ends = drafts.select(*node, F.explode(F.array_distinct(F.array_compact(F.col(spans)))).alias("span_"))
    shared = ends.groupBy(*group, "span_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = ends.join(shared, [*group, "span_"], "left_semi")
    left, decided, rounds = materialize(ends.join(met.select(*node).distinct(), node, "left_semi")), [], 0
    while not left.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"drafts still wait for one another after {max_rounds} rounds")
        first = left.groupBy(*group, "span_").agg(F.min(place).alias("first_"))
        winners = left.join(first, [*group, "span_"]).groupBy(*node).agg(F.bool_and(F.col("first_") == F.col(place)).alias("kept")).where("kept")
        winners = materialize(winners)
        held = left.join(winners, node, "left_semi").select(*group, "span_")
        losers = left.join(held, [*group, "span_"], "left_semi").select(*node).distinct().join(winners, node, "left_anti")
        done = materialize(winners.unionByName(losers.withColumn("kept", F.lit(False))))
        decided.append(done)
        left, rounds = materialize(left.join(done, node, "left_anti")), rounds + 1
    if not decided:
        return drafts.withColumn("kept", F.lit(True)), 0
    known = reduce(DataFrame.unionByName, decided)
    return drafts.join(known, node, "left").withColumn("kept", F.coalesce("kept", F.lit(True))).select(*drafts.columns, "kept"), rounds


def kept_in_order(drafts: DataFrame, group: list[str], place: str, spans: str, walked: int = WALKED) -> DataFrame:
    """``drafts`` with ``kept``, as ``first_independent`` decides; for drafts that mostly meet others, as they are moved once instead of several times a round.

    A group of at most ``walked`` spans (repeats included) becomes one row, whose drafts are walked in order of ``place``. Larger
    groups go by rounds, so no task holds one. Drafts without spans, group or place neither wait nor hold: they stay where they are.
    """
    drafts = materialize(drafts)
    waits = F.coalesce(F.exists(spans, lambda s: s.isNotNull()), F.lit(False))
    for c in (*group, place):
        waits &= F.col(c).isNotNull()
    asked = drafts.where(waits)
    large = materialize(asked.groupBy(*group).agg(F.sum(F.size(spans)).alias("n")).where(F.col("n") > walked).select(*group))
    some = not large.isEmpty()
    small = asked.join(large, group, "left_anti") if some else asked
    in_order = lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0)
    rows = small.repartition(parts(drafts), *group).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*(c for c in drafts.columns if c not in group))), in_order).alias("draft_"))

    def step(done, draft):
        own = F.array_compact(draft[spans])
        free = ~F.arrays_overlap(done["held"], own)
        return F.struct(F.when(free, F.concat(done["held"], own)).otherwise(done["held"]).alias("held"), F.array_append(done["kept"], free).alias("kept"))

    none = F.struct(F.array().cast(drafts.schema[spans].dataType).alias("held"), F.array().cast("array<boolean>").alias("kept"))
    rows = rows.select(*group, F.explode(F.arrays_zip("draft_", F.aggregate("draft_", none, step, lambda done: done["kept"]).alias("kept"))).alias("x_"))
    done = rows.select(*(F.col(c) if c in group else F.col("x_.draft_")[c].alias(c) for c in drafts.columns), F.col("x_.kept").alias("kept"))
    done = done.unionByName(drafts.where(~waits).withColumn("kept", F.lit(True)))
    if some:
        done = done.unionByName(first_independent(asked.join(large, group, "left_semi"), group, place, spans)[0])
    return done


def demoted_results(drafts: DataFrame, group: list[str], place: str) -> DataFrame:
    """Drafts (result_text, result_kind, result_spans, flags) of which each outcome span backs one result at most.

    A later draft with a span of an earlier one keeps its work and loses its result: no text, kind ``missing``,
    no spans, one flag more. Spans are compared without regard to white space; blank ones are none.
    """
    clean = F.filter(F.transform("result_spans", lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    chosen, _ = first_independent(drafts.withColumn("result_spans", clean), group, place, "result_spans")
    lost = ~F.col("kept")
    return chosen.withColumns({
        "result_text": F.when(~lost, F.col("result_text")), "result_kind": F.when(lost, "missing").otherwise(F.col("result_kind")),
        "result_spans": F.when(lost, F.array().cast("array<string>")).otherwise(F.col("result_spans")),
        "flags": F.when(lost, F.array_append("flags", DUPLICATE_OUTCOME)).otherwise(F.col("flags")),
    }).drop("kept")


def new_content(drafts: DataFrame, existing: DataFrame, runs: DataFrame) -> DataFrame:
    """``drafts`` with ``duplicate``: why a draft is not queued, null if it is.

    drafts: entity, place, fingerprint; existing claims: entity, reviewed, fingerprint; runs: entity, turn
    (the order in which entities are done, each once). When an entity's turn comes, its unreviewed claims give way
    to its drafts. So content is ``decided`` if a reviewed claim has it, ``queued_elsewhere`` if an unreviewed claim
    of an entity without a turn, or whose turn is still to come, has it, and ``earlier_draft`` if a draft accepted
    before has it. Each fingerprint can be judged by itself: the last turn of its old claims is where drafts
    begin to count, and the first draft from there on is the one. Drafts of entities without a turn are ``no_turn``.
    """
    old = existing.join(runs, "entity", "left").groupBy("fingerprint").agg(
        F.coalesce(F.max("reviewed"), F.lit(False)).alias("decided"), F.coalesce(F.max(F.col("turn").isNull() & ~F.col("reviewed")), F.lit(False)).alias("elsewhere"), F.max(F.when(~F.col("reviewed"), F.col("turn"))).alias("last_turn"),
    )
    rows = drafts.join(runs, "entity", "left").join(old, "fingerprint", "left")
    waits = F.coalesce("elsewhere", F.lit(False)) | (F.coalesce(F.col("turn") < F.col("last_turn"), F.lit(False)))
    rows = rows.withColumn("duplicate", F.when(F.col("turn").isNull(), "no_turn").when(F.col("decided"), "decided").when(waits, "queued_elsewhere"))
    first = rows.where("duplicate is null").groupBy("fingerprint").agg(F.min(F.struct("turn", "place")).alias("first")).select(F.col("first.turn").alias("turn"), F.col("first.place").alias("place"), F.lit(True).alias("is_first"))
    rows = rows.join(first, ["turn", "place"], "left")
    return rows.select(*drafts.columns, F.when(F.col("duplicate").isNull() & F.col("is_first").isNull(), "earlier_draft").otherwise(F.col("duplicate")).alias("duplicate"))
