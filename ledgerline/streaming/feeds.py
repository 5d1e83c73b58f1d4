"""The polled jobs as streams: look-back windows, deduplication, merges and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.lexicon import TRANSITIONS


def feed(spark: SparkSession, path: str, schema: T.StructType, at: str, look_back: str = "24 hours") -> DataFrame:
    """New files of a folder as a stream; rows without a time are dropped, and late ones beyond the look-back."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp")).where(F.col(at).isNotNull()).withWatermark(at, look_back)


def once_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows by natural key once within the watermark: seeing a message again changes nothing."""
    return rows.dropDuplicatesWithinWatermark(key)


def counts(rows: DataFrame, at: str, kind: str, width: str = "1 day") -> DataFrame:
    """Rows per window and kind."""
    return rows.groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def merged_into(rows: DataFrame, read: Callable[[], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run what there is in micro-batches: each is merged into the table and written as its next version."""

    def one(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch), number)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def illegal_steps(rows: DataFrame, key: str, state: str, kind: str) -> DataFrame:
    """(key, from_state, to_state) of steps in arrival order that the machine ``kind`` doesn't allow, with the last state kept per key."""
    legal = set(TRANSITIONS[kind])
    key_type = rows.schema[key].dataType

    def run(keys, batches, held: GroupState):
        import pandas as pd

        last, out = (held.get[0] if held.exists else None), []
        for pdf in batches:
            for now in pdf[state]:
                if last is not None and now != last and (last, now) not in legal:
                    out.append((keys[0], last, now))
                last = now
        if last is not None:
            held.update((last,))
        yield pd.DataFrame(out, columns=[key, "from_state", "to_state"])

    out = T.StructType([T.StructField(key, key_type), T.StructField("from_state", T.StringType()), T.StructField("to_state", T.StringType())])
    return rows.groupBy(key).applyInPandasWithState(run, out, "last string", "append", GroupStateTimeout.NoTimeout)
