"""Places and batches in order, with groups that lie in many ranges and buckets."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import order


def greedy(sizes, rows, size):
    out, batch, count, total = [], 0, 0, 0
    for k, n in enumerate(sizes):
        if k and (count + 1 > rows or total + n > size):
            batch, count, total = batch + 1, 0, 0
        count, total = count + 1, total + n
        out.append(batch)
    return out


@pytest.mark.parametrize(("rows", "size", "bucket"), [(3, 10, 4), (5, 40, 7), (30, 14_000, 64), (1, 5, 1), (4, 0, 4)])
def test_batches_equal_the_greedy_walk(spark, rows, size, bucket):
    rng = random.Random(rows)
    groups = {"a": 500, "b": 1, "c": bucket, "d": bucket + 1, None: 40}
    data = [(g, k * 3, rng.choice([0, 1, 2, 3, 5, 11, size, size + 1, rng.randrange(2 * size // 3 + 1)])) for g, n in groups.items() for k in range(n)]
    frame = spark.createDataFrame(random.Random(1).sample(data, len(data)), "g string, o int, n int").repartition(5)
    got = order.batches(frame, "g", "o", "n", rows, size, bucket)
    assert got.columns == ["g", "o", "batch"]
    found = {}
    for r in got.collect():
        found.setdefault(r["g"], {})[r["o"]] = r["batch"]
    for g in groups:
        own = [(o, n) for gg, o, n in data if gg == g]
        assert [found[g][o] for o, _ in own] == greedy([n for _, n in own], rows, size)


def test_no_rows(spark):
    assert order.batches(spark.createDataFrame([], "g string, o int, n int"), "g", "o", "n", 3, 10).count() == 0


def test_places_within_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), (3000 - F.col("id")).alias("o"))
    got = order.indexed(rows.repartition(7), "g", ["o"], "i").collect()
    assert all(r["i"] == (r["o"] - (1 if r["g"] else 2)) // 2 for r in got) and len(got) == 3000
