import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.llm import queries, quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("quality", "score", "predicted").toPandas()
    assert len(rows) > 500
    assert (rows["predicted"] == rows["quality"]).mean() > 0.98
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all()


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert spark.range(1).select(quality.held_out(F.lit(None).cast("long"))).first()[0] is True


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables + a.pair_tables, b.tables + b.pair_tables, strict=True))


def test_the_sample_is_that_of_the_smallest_hashes(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("quality"))
    few = quality.train(docs, labels, sample_rows=50)
    chosen = labels.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(50)
    want = quality.train(docs, chosen, sample_rows=1000)
    assert few.base == want.base and all(np.array_equal(a, b) for a, b in zip(few.tables, want.tables, strict=True))


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction alone
    model = quality.fit(x, y, pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    b = model.bins(x)
    total = model.base + sum(t[b[:, j]] for j, t in enumerate(model.tables)) + model.pair_tables[0][b[:, 0], b[:, 1]]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))


def test_features_do_not_depend_on_the_batch():
    texts = ["A b b.", None, "", "ÜBER 12!!\nx | y", "word " * 50, "é" * 30]
    whole = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features(pa.array([t]))[0])
    assert not whole[1].any() and not whole[2].any()
    assert whole[4][quality.FEATURES.index("distinct_share")] == 1 / 50


def test_awkward_rows(spark, tricky, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(tricky, labels)
    out = quality.score_quality(tricky, model)
    assert out.columns == [*tricky.columns, "quality_score_"]
    rows = out.collect()
    assert len(rows) == tricky.count() and all(0 <= r["quality_score_"] <= 1 for r in rows)
    assert len({r["quality_score_"] for r in rows if not r["text"]}) == 1
    assert quality.score_quality(nothing, model).count() == 0
    assert quality.train(nothing, labels).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.keep_good(tricky, labels).columns == tricky.columns


def plain_features(text):
    """The features of one text, word by word and byte by byte."""
    data = (text or "").encode()
    words, size = data.split(), len(data)
    mark = lambda b: chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    odd = lambda b: mark(b) and chr(b) not in ".,;:'\"-?()"
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    of_size = lambda n: n / size if size else 0.0
    of_words = lambda n: n / len(words) if words else 0.0
    return [
        math.log1p(len(words)), math.log1p(data.count(b"\n")), of_words(sum(map(len, words))), upper / (upper + lower) if upper + lower else 0.0, of_size(sum(map(mark, data))), of_size(sum(map(odd, data))),
        of_size(sum(48 <= b <= 57 for b in data)), of_size(sum(b >= 128 for b in data)), of_size(size - sum(map(len, words))), of_words(sum(65 <= w[0] <= 90 for w in words)), of_words(sum(len(w) == 1 and mark(w[0]) for w in words)),
        of_words(sum(odd(w[-1]) for w in words)), of_words(sum(a == b for a, b in zip(words, words[1:], strict=False))), of_words(len(set(words))), of_words(sum(len(w) <= 3 for w in words)), math.log1p(max(map(len, words), default=0)),
    ]


def test_features_equal_a_plain_count(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [None, "", " \n\t", "A", "!! ?? a! b*", "Über Über 😀 x\x0by", "UPPER lower 123 a1\n\n- - *", "a" * 5000 + " b"]
    got = quality.features(pa.array(texts, pa.string()))
    assert np.allclose(got, np.array([plain_features(t) for t in texts]), rtol=1e-12, atol=1e-12)
