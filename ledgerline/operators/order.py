"""Places of rows within groups of any size, and batches in order, without a task that holds a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.tables import materialize

#: So many rows of a group are looked at together.
BUCKET = 4096


def indexed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (a table afterwards) with ``name``: 0, 1, 2... in order within each group; a null group is a group.

    Rows are sorted over ranges, so a group may lie in many of them; a row count for each group and range, added up
    over the ranges before, shows where a range of a group begins.
    """
    at, part, local = "at_", "part_", "local_"
    placed = rows.orderBy(F.col(group).asc_nulls_first(), *order).withColumn(at, F.monotonically_increasing_id())
    placed = materialize(placed.withColumn(part, F.shiftright(at, 33)))
    sizes = placed.groupBy(F.col(group).alias("g_"), F.col(part).alias("p_")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_"))
    before = W.partitionBy("g_").orderBy("p_").rowsBetween(W.unboundedPreceding, -1)  # one row a range of a group
    begins = sizes.select("g_", "p_", (F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")) - F.col("first_")).alias(local))
    joined = placed.join(begins, F.col(group).eqNullSafe(F.col("g_")) & (F.col(part) == F.col("p_")))
    return joined.select(*rows.columns, (F.col(at) + F.col(local)).alias(name))


def _jumps(sizes: np.ndarray, own: int, most_rows: int, most_size: int) -> np.ndarray:
    """Where the batch after one that begins at each of the first ``own`` rows begins."""
    ends = np.cumsum(sizes)
    starts = ends[:own] - sizes[:own]
    full = np.searchsorted(ends, starts + most_size, side="right")
    at = np.arange(own)
    return np.minimum(np.maximum(full, at + 1), at + most_rows)


def batches(rows: DataFrame, group: str, order: str, size: str, most_rows: int, most_size: int, bucket: int = BUCKET) -> DataFrame:
    """(group, order, batch): greedy batches of a group in order, of at most ``most_rows`` rows and ``most_size``; a row beyond that is a batch alone.

    A batch has at most ``most_rows`` rows, so the first batch that begins in a bucket of a group does so at one of its first
    ``most_rows`` rows. For each of these a bucket tells at which row of the next bucket the chain of batches
    arrives, and how many batches have begun. These small tables are joined over distances that double, which
    gives every bucket its entry; then each numbers its rows by itself.
    """
    bucket = max(bucket, most_rows)
    placed = indexed(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("n")), "g", ["o"], "i")
    block, inside = F.floor(F.col("i") / bucket).cast("long"), F.col("i") % bucket
    ahead = placed.where((inside < most_rows - 1) & (F.col("i") >= bucket)).select("g", (block - 1).alias("b"), (inside + bucket).alias("k"), "n", F.lit(None).cast(placed.schema["o"].dataType).alias("o"))
    held = placed.select("g", block.alias("b"), inside.alias("k"), "n", "o").unionByName(ahead).groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct("k", "n", "o"))).alias("x"))  # at most bucket + most_rows rows
    held = materialize(held.select("g", "b", F.col("x.n").alias("sizes"), F.slice("x.o", 1, bucket).alias("orders"), F.least(F.size("x"), F.lit(bucket)).alias("own")))

    @F.arrow_udf("struct<leads: array<int>, counts: array<long>>")
    def passage(sizes: pa.Array, own: pa.Array) -> pa.Array:
        leads, counts = [], []
        for listed, n in zip(sizes, own, strict=True):
            n = n.as_py()
            jump = _jumps(listed.values.to_numpy(zero_copy_only=False), n, most_rows, most_size)
            out, begun = np.zeros(n, np.int64), np.ones(n, np.int64)
            for k in range(n - 1, -1, -1):
                out[k], begun[k] = (jump[k] - bucket, 1) if jump[k] >= n else (out[jump[k]], 1 + begun[jump[k]])
            leads.append(np.maximum(out[:most_rows], 0))
            counts.append(begun[:most_rows])
        return pa.StructArray.from_arrays([pa.array(leads, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["leads", "counts"])

    # the passage through the buckets up to this one and including it, from so many before; only the path from row 0 matters in the end
    maps = materialize(held.select("g", "b", passage("sizes", "own").alias("m")).select("g", "b", "m.leads", "m.counts"))
    last = maps.agg(F.max("b")).first()[0] or 0
    step = 1
    while step <= last:
        past = maps.select(F.col("g").alias("g_"), (F.col("b") + step).alias("b_"), F.col("leads").alias("leads_"), F.col("counts").alias("counts_"))
        both = maps.join(past, F.col("g").eqNullSafe(F.col("g_")) & (F.col("b") == F.col("b_")), "left")
        leads = F.transform("leads_", lambda k: F.get("leads", k))
        counts = F.zip_with("leads_", "counts_", lambda k, n: n + F.get("counts", k))
        maps = materialize(both.select("g", "b", F.coalesce(leads, "leads").alias("leads"), F.coalesce(counts, "counts").alias("counts")))
        step *= 2
    entries = maps.select(F.col("g").alias("g_"), (F.col("b") + 1).alias("b_"), F.get("leads", F.lit(0)).alias("entry"), F.get("counts", F.lit(0)).alias("begun"))
    ready = held.join(entries, F.col("g").eqNullSafe(F.col("g_")) & (F.col("b") == F.col("b_")), "left").select("g", "sizes", "own", "orders", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("begun", F.lit(0).cast("long")).alias("begun"))

    @F.arrow_udf("array<int>")
    def numbered(sizes: pa.Array, own: pa.Array, entry: pa.Array, begun: pa.Array) -> pa.Array:
        out = []
        for listed, n, first, before in zip(sizes, own, entry, begun, strict=True):
            n = n.as_py()
            jump, k, starts = _jumps(listed.values.to_numpy(zero_copy_only=False), n, most_rows, most_size), first.as_py(), np.zeros(n, np.int64)
            while k < n:
                starts[k] = 1
                k = int(jump[k])
            out.append(np.cumsum(starts) + before.as_py() - 1)
        return pa.array(out, pa.list_(pa.int32()))

    named = ready.select("g", F.explode(F.arrays_zip("orders", numbered("sizes", "own", "entry", "begun").alias("numbers"))).alias("z"))
    return named.select(F.col("g").alias(group), F.col("z.orders").alias(order), F.col("z.numbers").alias("batch"))
