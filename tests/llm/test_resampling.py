import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import resampling
from ledgerline.llm.common import global_ranks
from ledgerline.llm.queries import op13_resampling

LOWER = str.maketrans(resampling.UPPER, resampling.LOWER)


def features(text, ngram=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    gains = resampling.bucket_gains(count(t for _, t in docs), count(target))
    rows = []
    for d, t in docs:
        n, found = features(t)
        weight = sum(gains[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(able)]
    cut = percent * len(able) // 100
    return sorted(((*r[:4], r[4] if r[4] <= cut else None) for r in drawn), key=str), sorted(((*r[:4], None) for r in rows if not r[4]), key=str)


def held(got, docs, target):
    able, rest = brute(docs, target)
    assert sorted(map(tuple, got), key=str) == sorted(able + rest, key=str)


def test_whole_table(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    got = op13_resampling(spark, sf_dir).collect()
    held(got, [(r["doc_id"], r["text"]) for r in read("documents").collect()], [r["text"] for r in read("benchmark").collect()])
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    want = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in got) + 1))


def test_awkward_rows(spark, tricky, nothing):
    target = ["w1 w2 w3 Über", None, ""]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    held(resampling.resample(tricky, table).collect(), [(r["doc_id"], r["text"]) for r in tricky.collect()], target)
    assert resampling.resample(nothing, table).count() == 0
    held(resampling.resample(tricky, table.limit(0)).collect(), [(r["doc_id"], r["text"]) for r in tricky.collect()], [])


def test_words_beyond_ascii_and_null_bytes(spark):
    rows = [(1, "ÀÉ é ÀÉ 😀x\x00y {a} `b` A-Z_0"), (2, "\x00"), (3, "x" * 200_000)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select(resampling.words_column(F.col("text"))).collect()
    assert [r[0] for r in got] == [["ÀÉ", "é", "ÀÉ", "😀x", "y", "a", "b", "a", "z", "0"], [], ["x" * 200_000]]


@pytest.mark.parametrize("ngram", [1, 3])
def test_other_runs_of_words(spark, ngram):
    texts = ["a b c d a b", "a", "", "a b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(resampling.buckets_column(resampling.words_column(F.col("t")), ngram, 97)).collect()
    assert [r[0] for r in got] == [[zlib.crc32(f.encode()) % 97 for f in features(t, ngram)[1]] for t in texts]


def test_target_like_documents_are_drawn_more_often(spark):
    docs = [(i, " ".join(f"{'good' if i % 2 else 'other'}{(i * 7 + k) % 40}" for k in range(25))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(f"good{k}" for k in range(40)),)] * 200, "text string")
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(got) == 100 and sum(r["doc_id"] % 2 for r in got) > 80


def test_equal_rows_get_ranks_of_their_own(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.lit("x").alias("part"))
    got, total = global_ranks(rows, [F.col("k").desc()], "rank")
    assert total == 3000 and got.columns == ["k", "part", "rank"]
    ranks = {k: sorted(r["rank"] for r in got.where(F.col("k") == k).collect()) for k in range(3)}
    assert ranks == {2: list(range(1, 1001)), 1: list(range(1001, 2001)), 0: list(range(2001, 3001))}
