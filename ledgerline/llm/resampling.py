"""Target-distribution importance resampling: documents drawn by how much likelier a target makes their words.

A text's features are its runs of one to ``NGRAM`` consecutive words, hashed into
``BUCKETS`` buckets. A bucket's gain is the logarithm of its share in the target
over its share in the source, both smoothed by one. A document's weight is the mean
gain of its features, and the documents with the highest weight plus Gumbel noise
are drawn, which is sampling without replacement in proportion to exp(weight).

Higher-order functions turn a text into the array of its buckets and fold that array
over a literal array of gains, so scoring neither explodes nor shuffles; only the counts of
buckets, at most BUCKETS of them from each task, are shuffled. Ranks come from one sort
over ranges and the row counts of the ranges.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, global_ranks, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, APART = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, NGRAM = 10_000, 2
SEED, LEAST_WORDS, PERCENT = 7, 20, 25


def words_column(text: Column) -> Column:
    """Words of ASCII digits, letters (A-Z in lower case) and all characters beyond ASCII; a null text has none.

    The text is split at what lies between words, which is linear in its length; regexp_extract_all copies the text for every match.
    """
    return F.array_remove(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), APART), "")


def buckets_column(words: Column, ngram: int = NGRAM, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to ``ngram`` consecutive words, repeats included."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature) % buckets).cast("int")

    def runs(size: int) -> Column:
        count = F.greatest(F.size(words) - (size - 1), F.lit(0))
        joined = reduce(lambda done, k: F.zip_with(done, F.slice(words, F.lit(k + 1), count), lambda a, b: F.concat(a, F.lit(" "), b)), range(1, size - 1), F.slice(words, F.lit(1), count))
        if size == 1:
            return F.transform(words, bucket)
        return F.zip_with(joined, F.slice(words, F.lit(size), count), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))

    return F.concat(*(runs(size) for size in range(1, ngram + 1)))


def bucket_counts(texts: DataFrame, text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs in all texts; tasks send at most ``buckets`` counts each, and as many come to the driver."""
    found = texts.select(words_column(F.col(f"`{text}`")).alias("words")).select(F.explode(buckets_column(F.col("words"), ngram, buckets)).alias("bucket"))
    counts = [0] * buckets
    for bucket, n in found.groupBy("bucket").agg(F.count(F.lit(1))).collect():
        counts[bucket] = n
    return counts


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(share in target / share in source)) of each bucket, both shares smoothed by one."""
    size, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size)))) for s, t in zip(source, target, strict=True)]


def gumbel_column(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel noise) from a hash of the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score_documents(docs: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text", seed: int = SEED, ngram: int = NGRAM) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score (all long); columns of these names are replaced.

    weight: floored mean of the gains of all features, 0 without any. score: weight plus noise.
    """
    words, found = fresh(docs, "words", "n_words", "n_features", "weight", "score"), fresh(docs, "buckets", "n_words", "n_features", "weight", "score")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_features", "weight", "score")]
    known = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<int>")  # folded to one literal
    total = F.aggregate(F.col(found), F.lit(0).cast("long"), lambda done, b: done + F.element_at(known, b + 1))
    n = F.size(found).cast("long")
    out = docs.withColumn(words, words_column(F.col(f"`{text}`"))).withColumn(found, buckets_column(F.col(words), ngram, len(gains)))
    out = out.select(*own, F.size(words).cast("long").alias("n_words"), n.alias("n_features"), total.alias(found))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"(`{found}` - pmod(`{found}`, n_features)) div n_features"))
    return out.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel_column(F.col(f"`{key}`"), seed)).drop(found)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(``key``, n_features, weight, score, rank) of every row of ``docs``; rank 1, 2, 3... of the drawn ones, null for the others.

    Of the N rows with at least ``least_words`` words the floor(percent N / 100) with the highest
    scores are drawn, ties to the smaller key. A null text has no features, weight 0 and is never
    drawn; a null key counts as empty in the noise and comes last in ties; a repeated row is
    a row of its own with the same score and takes a rank of its own; an empty ``docs`` gives no
    rows, an empty ``target`` is smoothed like any other.
    """
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias(fresh(docs.select(F.col(f"`{key}`")), "text")))
    body = rows.columns[1]
    gains = bucket_gains(bucket_counts(rows, body, ngram, buckets), bucket_counts(target, target_text, ngram, buckets))
    scored = materialize(score_documents(rows, gains, key, body, seed, ngram).drop(body))
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked, total = global_ranks(able, order, "rank")
    names = [F.col(f"`{c}`") for c in (key, "n_features", "weight", "score")]
    drawn = ranked.select(*names, F.when(F.col("rank") <= total * percent // 100, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank")))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLE_SQL = f"""
WITH crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS MATERIALIZED (
  SELECT 'd' AS side, doc_id AS id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []::VARCHAR[]) AS w FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []::VARCHAR[]) FROM benchmark),
features AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM (
  SELECT side, id, unnest(w) AS f FROM texts UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, {_CRC} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM features), crc),
counted AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {BUCKETS}))::DOUBLE / ((s + 1) * (sum(t) OVER () + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM counted),
summed AS (SELECT id, sum(n * gain)::BIGINT AS total FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
weighed AS (SELECT id AS doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_features,
  CASE WHEN len(w) = 0 THEN 0 ELSE floor(total / (2 * len(w) - 1))::BIGINT END AS weight, ('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN summed USING (id) WHERE side = 'd'),
scored AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n_able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n_able // 100 THEN place END AS rank FROM ranked
"""
