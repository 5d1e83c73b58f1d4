"""Change sets: one plan of inserts, updates and deletes over several tables, applied to their generations at once.

A change is a row of CHANGES: the table it is for, what it does, the key of its row, the columns it
sets (as text, arrays and structs as JSON), whether it gives way to a human decision, and its place in
the plan. Changes of one row are folded in order of their places, so every table is joined once, whatever
the length of the plan. Applying a plan twice gives what applying it once gives.

    insert   makes the row; refused where it exists
    update   sets columns of a row; refused where it is absent
    upsert   insert or update
    delete   takes the row away; nothing to do where it is absent
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.tables import materialize, parts

CHANGES = "target string, op string, key string, columns map<string, string>, yields boolean, place long"
OUTCOMES = ("applied", "no_key", "decided", "exists", "absent", "no_parent")


@dataclass(frozen=True)
class Target:
    """A table of a plan: its rows, its key columns, which rows carry a decision, and the table (its key under the same names) that must hold the key of every new row."""

    rows: DataFrame
    key: list[str]
    decided: Column | None = None
    parent: DataFrame | None = None


def key_text(*columns: Column) -> Column:
    """Key columns as one text, the way changes name a row: a single one as it is, several as a JSON array. Null if one is null."""
    texts = [c.cast("string") for c in columns]
    return texts[0] if len(texts) == 1 else F.when(F.forall(F.array(*texts), lambda t: t.isNotNull()), F.to_json(F.array(*texts)))


def change(rows: DataFrame, target: str, op: str, key: dict[str, Column], columns: dict[str, Column], place: Column | int = 0, yields: bool = True, untouched: bool = False) -> DataFrame:
    """One change for each of ``rows``. Arrays, maps and structs among ``columns`` go in as JSON.

    A null value sets null, or with ``untouched`` leaves the column as it is.
    """
    put = (key if op in ("insert", "upsert") else {}) | columns
    kinds = rows.select(*(c.alias(n) for n, c in put.items())).schema if put else []
    nested = {f.name for f in kinds if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    pairs = [x for n, c in put.items() for x in (F.lit(n), F.to_json(c) if n in nested else c.cast("string"))]
    values = F.create_map(*pairs) if pairs else F.create_map()
    values = values.cast("map<string,string>")
    if untouched:
        values = F.map_filter(values, lambda _, v: v.isNotNull())
    at = F.lit(place) if isinstance(place, int) else place
    return rows.select(F.lit(target).alias("target"), F.lit(op).alias("op"), key_text(*key.values()).alias("key"), values.alias("columns"), F.lit(yields).alias("yields"), at.cast("long").alias("place"))


def _value(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.from_json(text, kind)
    return text.cast(kind)


def _folded(changes: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key: whether a change before the first delete needs the row, what is left after the last, and the last value of every column set since."""
    last = F.max(F.when(F.col("op") == "delete", F.col("place"))).over(W.partitionBy("key"))
    live = changes.withColumn("gone_at", last).where("gone_at is null or place >= gone_at")
    after = F.col("gone_at").isNull() | (F.col("place") > F.col("gone_at"))
    sets = [F.max(F.when(after & F.map_contains_key("columns", c), F.struct("place", F.col("columns")[c].alias("v")))).alias(f"set_{c}") for c in columns]
    return live.groupBy("key").agg(
        F.max(F.col("gone_at").isNotNull()).alias("deletes"), F.max(after & F.col("op").isin("insert", "upsert")).alias("makes"), F.max(after & (F.col("op") != "delete")).alias("touches"), *sets,
    )


def outcomes(target: Target, changes: DataFrame, n: int | None = None) -> DataFrame:
    """``changes`` of one table with ``outcome``. They meet the table in ``n`` parts, by default as many as the rows ask for.

    A row exists for a change if the table has it and no earlier change of the plan deleted it, or if an
    earlier one made it. A change that yields is ``decided`` where the table's row carries a decision.
    New rows without their parent are ``no_parent``; changes whose key is null are ``no_key``.
    """
    decided = F.coalesce(target.decided, F.lit(False)) if target.decided is not None else F.lit(False)
    here = target.rows.select(key_text(*(F.col(f"`{c}`") for c in target.key)).alias("key"), F.lit(True).alias("in_table"), decided.alias("is_decided"))
    n = n or parts(changes, target.rows)
    rows = changes.repartition(n, "key").join(here.repartition(n, "key"), "key", "left").withColumns({"in_table": F.coalesce("in_table", F.lit(False)), "is_decided": F.coalesce("is_decided", F.lit(False)) & F.col("yields")})
    has_parent = F.lit(True)
    if target.parent is not None:
        parents = target.parent.select(*(F.col(f"`{c}`") for c in target.key)).distinct().select(key_text(*(F.col(f"`{c}`") for c in target.key)).alias("key"), F.lit(True).alias("has_parent"))
        rows = rows.join(parents, "key", "left")
        has_parent = F.coalesce("has_parent", F.lit(False))
    before = W.partitionBy("key").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    counts = F.when((F.col("op") == "delete") & ~F.col("is_decided"), F.struct("place", F.lit(False).alias("there"))).when(F.col("op").isin("insert", "upsert") & ~F.col("is_decided") & has_parent, F.struct("place", F.lit(True).alias("there")))
    there = F.coalesce(F.max(counts).over(before)["there"], F.col("in_table"))
    rows = rows.withColumn("there", there)
    outcome = (
        F.when(F.col("key").isNull(), "no_key")
        .when(F.col("is_decided"), "decided")
        .when((F.col("op") == "insert") & F.col("there"), "exists")
        .when((F.col("op") == "update") & ~F.col("there"), "absent")
        .when(F.col("op").isin("insert", "upsert") & ~F.col("there") & ~has_parent, "no_parent")
        .otherwise("applied")
    )
    return rows.select(*changes.columns, outcome.alias("outcome"))


def apply_changes(targets: dict[str, Target], changes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The next generation of every table, and the log: ``changes`` (of CHANGES, in places that differ for each row) with ``outcome``.

    Changes for tables that ``targets`` does not name stay out of both. Rows that no applied change names stay as
    they are; each table is read once more than its join needs only to see which of its rows exist, and counted, as changes and
    rows meet in parts whose size does not grow with them.
    """
    changes = materialize(changes)
    logs, tables = None, {}
    for name, target in targets.items():
        mine = changes.where(F.col("target") == name)
        n = parts(mine, target.rows)
        log = materialize(outcomes(target, mine, n))
        logs = log if logs is None else logs.unionByName(log)
        kinds = {f.name: f.dataType for f in target.rows.schema}
        rest = [c for c in kinds if c not in target.key]
        folded = _folded(log.where("outcome = 'applied'").repartition(n, "key"), list(kinds))
        own = target.rows.withColumn("key_", key_text(*(F.col(f"`{c}`") for c in target.key))).withColumn("in_table", F.lit(True))
        both = own.repartition(n, "key_").join(folded.withColumnRenamed("key", "key_"), "key_", "full_outer")
        stays = F.col("in_table") & ~F.coalesce("deletes", F.lit(False))
        both = both.where(stays | F.coalesce("makes", F.lit(False)))

        def value(c: str, kinds=kinds, stays=stays) -> Column:
            found = F.col(f"set_{c}")
            return F.when(found.isNotNull(), _value(found["v"], kinds[c])).otherwise(F.when(F.coalesce(stays, F.lit(False)), F.col(f"`{c}`"))).alias(c)

        tables[name] = both.select(*(value(c) if c in rest else F.coalesce(_value(F.col(f"set_{c}")["v"], kinds[c]), F.col(f"`{c}`")).alias(c) for c in kinds))
    return tables, logs
