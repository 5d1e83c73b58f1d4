"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: So many rows of a large table are joined and grouped in one task.
ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one only where none is named and the session is local; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ledgerline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of the scope that the running thread is in.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that this thread materializes inside are deleted at the end; the paths that the caller takes out of the list stay.

    Scopes nest; a table belongs to the innermost. Other threads have scopes of their own.
    """
    paths: list[str] = []
    before = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(before)
        hadoop, java = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            where = java.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there and any executor may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(*frames: DataFrame) -> int:
    """So many partitions that each gets about ``ROWS`` rows of the largest of ``frames``, one a core at least."""
    return max(frames[0].sparkSession.sparkContext.defaultParallelism, *(-(-f.count() // ROWS) for f in frames))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by keys over so many partitions that each gets about ``ROWS`` rows; what is joined or grouped by these keys then stays so.

    Spark would join small partitions until there is one for each core, so that what a task sorts and hashes grows with the input. The
    rows are counted first, which a table's footers answer.
    """
    return rows.repartition(parts(rows), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: both sides are sorted by the keys.

    For what grows with the input but looks small to Spark, which takes a table for as large as its compressed files and an explode for
    one row a row, and so would gather on the driver what doesn't fit there.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
