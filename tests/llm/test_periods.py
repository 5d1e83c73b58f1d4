import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import periods
from ledgerline.llm.queries import op12_periods


def brute_runs(words, least=24, times=3):
    """For every period, stretches in which words that far apart are identical; those of a multiple of a smaller period of the same stretch go."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            first = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - first + q
            if length >= max(least, times * q) and not any(all(words[k] == words[k + d] for k in range(first, first + length - d)) for d in range(1, q)):
                out.append((first, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(b"".join(b"%d,%d,%d\n" % r for r in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(map(tuple, op12_periods(spark, sf_dir).collect()))
    assert got == sorted(brute(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10 and any(r[1] == 0 for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_random_words_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        ids, letters = [], rng.choice([1, 2, 3, 50])
        while len(ids) < rng.randint(0, 260):
            piece = [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
            ids += piece * rng.choice([1, 1, 2, 3, 5]) + piece[: rng.randint(0, len(piece))]
        assert periods.runs_of(ids) == brute_runs(ids)


def test_words_without_runs_and_with_many():
    fib, morse = [[0], [0, 1]], [0]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    while len(morse) < 4096:  # the words that break hashes modulo a power of two
        morse += [1 - x for x in morse]
    for ids in (fib[-1], morse[:1024], [5] * 300, [1, 2] * 200 + [1], [*range(400)], [*range(12)] * 3 + [7] * 23, [0] * 23, [0] * 24):
        assert periods.runs_of(ids) == brute_runs(ids)
    assert periods.runs_of(morse * 4) == [(0, 16384, 4096)]


def test_stretches_hold_runs_with_their_neighbours():
    ids = [*range(100), *([200, 201, 202] * 9), *range(300, 400)]
    assert list(periods.repeated_stretches(ids)) == [(99, 128)]
    assert periods.runs_of(ids) == [(100, 27, 3)]


def test_a_collision_leads_to_another_base(monkeypatch):
    ids = [*range(40)] * 4
    tried = []
    true = periods.Extensions.__init__

    def start(self, ids, base):
        tried.append(base)
        true(self, [0] * len(ids) if base == 2 else ids, base)
        self.ids = ids

    monkeypatch.setattr(periods, "BASES", [2, *periods.BASES])
    monkeypatch.setattr(periods.Extensions, "__init__", start)
    assert periods.runs_of(ids + [41] * 30 + ids) == brute_runs(ids + [41] * 30 + ids)
    assert tried[0] == 2 and len(set(tried)) > 1


def test_long_texts_end_soon():
    rng = random.Random(7)
    began = time.time()
    plain = [rng.randrange(10**6) for _ in range(300_000)]
    assert periods.runs_of(plain) == []
    assert periods.runs_of([3] * 200_000) == [(0, 200_000, 1)]
    assert periods.runs_of(plain[:30_000] * 5) == [(0, 150_000, 30_000)]
    assert time.time() - began < 30


def test_awkward_rows(spark, tricky, nothing):
    assert periods.run_digests(tricky).count() == tricky.count()
    small = tricky.where("doc_id is null or doc_id <> 7")
    assert sorted(map(tuple, periods.run_digests(small).collect()), key=str) == sorted((brute(r["doc_id"], r["text"]) for r in small.collect()), key=str)
    assert periods.run_digests(nothing).count() == 0
    clash = small.withColumn("runs", F.lit("old")).withColumn("facts", F.lit(1))
    assert periods.find_runs(clash).columns == [c for c in clash.columns if c != "runs"] + ["n_words", "runs", "collapsed"]


def test_equal_texts_have_equal_values_and_spaces_do_not_matter(spark):
    rows = [(1, "a b " * 20), (2, "\ta\vb\r\n" * 20), (3, "a b " * 30), (4, None)]
    got = {r["doc_id"]: r for r in periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["runs"] == got[2]["runs"] == [(0, 40, 2)] and got[1]["collapsed"] == got[2]["collapsed"] == "a b"
    assert got[3]["collapsed"] == "a b" and got[3]["n_words"] == 30 and got[4][2:] == (0, [], "")
