"""Results kept by content: what has been computed for a fingerprint and a version is read, only the rest is computed.

A store is a folder that all executors and runs share. Results of a run are a Parquet folder of
their own; a run then takes its turn by creating the next numbered file, which the file system grants to one run
only, and writes the folder's name into it. The rows of the earliest turn count for a fingerprint, so runs
that computed the same fingerprint at the same time agree once both have taken their turns, and nothing
recorded is ever replaced. A turn without a name after PATIENCE seconds belongs to a run that has died and is passed over; a
run that takes longer over it than half of that fails instead.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATIENCE = 60.0


class Memo:
    """A store of results (of ``schema``) below ``folder`` for one ``version`` of the code that computes them.

    The file system must create a file only where there is none (HDFS and local folders do).
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, version: str, patience: float = PATIENCE):
        self.spark, self.folder, self.version, self.patience = spark, folder.rstrip("/"), version, patience
        self._batches: dict[int, str] = {}
        self.schema = spark.createDataFrame([], schema).schema

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, system, path) -> str:
        """The batch that a turn's file names; empty for a run that has died."""
        until = time.time() + self.patience
        while True:
            size = system.getFileStatus(path).getLen()
            if size:
                stream = system.open(path)
                try:
                    return "".join(chr(stream.read()) for _ in range(size))
                finally:
                    stream.close()
            if time.time() > until:
                return ""
            time.sleep(0.05)

    def turns(self) -> dict[int, str]:
        """The batch of each turn taken."""
        system, root = self._system(), self._path("turns")
        if not system.exists(root):
            return {}
        paths = [f.getPath() for f in system.listStatus(root)]
        known = {int(p.getName()): p for p in paths if p.getName().isdigit()}
        self._batches |= {n: self._named(system, p) for n, p in known.items() if n not in self._batches}
        return {n: self._batches[n] for n in sorted(known) if self._batches[n]}

    def recorded(self) -> DataFrame:
        """(fingerprint, result columns) of this version: for each fingerprint the rows of the earliest turn that has it."""
        turns = self.turns()
        kept = [f"{self.folder}/batches/{b}" for b in turns.values()]
        full = T.StructType([T.StructField("version_", T.StringType()), T.StructField("fingerprint", T.StringType()), *self.schema.fields])
        if not kept:
            return self.spark.createDataFrame([], full).drop("version_")
        rows = self.spark.read.schema(full).parquet(*kept).where(F.col("version_") == self.version)
        order = self.spark.createDataFrame([(b, t) for t, b in turns.items()], "batch_ string, turn_ long")
        rows = rows.withColumn("batch_", F.regexp_extract(F.input_file_name(), "/batches/([0-9a-f]{32})/", 1)).join(F.broadcast(order), "batch_")  # one row a run
        first = rows.groupBy("fingerprint").agg(F.min("turn_").alias("turn_"))
        return rows.join(first, ["fingerprint", "turn_"]).select("fingerprint", *self.schema.names)

    def record(self, results: DataFrame) -> int:
        """Writes results (fingerprint and the schema's columns) and takes the next turn, whose number it gives."""
        batch = uuid.uuid4().hex
        results.select(F.lit(self.version).alias("version_"), "fingerprint", *self.schema.names).write.parquet(f"{self.folder}/batches/{batch}")
        system, n = self._system(), max(self.turns(), default=-1) + 1
        while True:
            path, began = self._path("turns", str(n)), time.time()
            try:
                stream = system.create(path, False)
            except Exception:  # another run has this turn
                if not system.exists(path):
                    raise
                n += 1
                continue
            stream.writeBytes(batch)
            stream.close()
            if time.time() - began > self.patience / 2:
                raise TimeoutError(f"turn {n} took too long; its batch may not count")
            return n

    def get(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """The results for ``inputs`` (with a column fingerprint), and how many fingerprints had to be computed.

        ``compute`` gets the rows of inputs whose fingerprint has no record, one for each fingerprint (the smallest
        by all columns), and gives fingerprint and the schema's columns, any number of rows a fingerprint. A fingerprint for which it
        gives none is computed again next time.
        """
        missing = inputs.join(self.recorded().select("fingerprint").distinct(), "fingerprint", "left_anti")
        rest = [c for c in inputs.columns if c != "fingerprint"]
        first = missing.groupBy("fingerprint").agg(F.min(F.struct(*rest)).alias("r")).select("fingerprint", "r.*") if rest else missing.distinct()
        first = first.select(*inputs.columns)
        n = first.count()
        if n:
            self.record(compute(first))
        return self.recorded().join(inputs.select("fingerprint").distinct(), "fingerprint", "left_semi"), n
