import random

import pytest

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import xxhash
from ledgerline.llm import common, linededup, simhash, suffixes
from ledgerline.operators.graph import connected_components


def rows_of(docs):
    """(id, text, place in order by id and hash of the text) with nulls first."""
    got = docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()
    return sorted(((r["doc_id"], r["text"], r["k"]) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- SimHash -------------------------------------------------------------------


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """{id: (fingerprint, smallest reachable id)} by comparing all."""
    left = {d: d for d, _ in pairs}
    codes = dict(pairs)
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if bin(codes[a] ^ codes[b]).count("1") <= 2 and left[b] < left[a]:
                    left[a], changed = left[b], True
    return {d: (f"{codes[d]:016x}", left[d]) for d in codes}


def test_simhash_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()])


def test_links_under_any_group_size(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(40)]
    codes += [c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for c in codes for _ in range(5)]
    codes = list(dict.fromkeys(codes))
    frame = spark.createDataFrame([(int(np.uint64(c).view(np.int64)), i) for i, c in enumerate(codes)], "fp long, rep long")
    want = brute_components(list(enumerate(codes)))
    for size in (3, 1000):
        parts = {r["node"]: r["component"] for r in connected_components(simhash.links(frame, 2, size)).collect()}
        assert {i: parts.get(i, i) for i in range(len(codes))} == {i: w[1] for i, w in want.items()}


def test_simhash_awkward_rows(spark, tricky, nothing):
    rows = simhash.simhash_components(tricky).collect()
    assert len(rows) == tricky.count()
    by = {r["doc_id"]: r for r in rows}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[3]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[11]["component_id"] == 10
    assert by[7]["fingerprint"] == f"{brute_fingerprint(next(r['text'] for r in tricky.collect() if r['doc_id'] == 7)):016x}"
    kept = simhash.simhash_dedup(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8, 9, 10]
    assert simhash.simhash_components(nothing).count() == 0 and simhash.simhash_dedup(nothing).count() == 0


def brute_near_kept(docs):
    """Ids that stay when all pairs of 5-word shingle sets are compared; ids are distinct."""
    sets = {}
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    left = {d: d for d in sets}

    def root(d):
        while left[d] != d:
            d = left[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and len(x & y) * 5 >= len(x | y) * 4:
                p, q = sorted((root(a), root(b)))
                left[q] = p
    return {d for d in order if root(d) == d}


def test_near_copies_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_near_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in simhash.near_dedup(docs).collect()} == want


def test_near_copies_around_the_bound(spark):
    rng = random.Random(5)
    docs = []
    for k in range(12):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))]
        for _ in range(10):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.near_dedup(frame).collect()}
    assert got == brute_near_kept(docs) and 12 <= len(got) < len(docs)
    assert simhash.simhash_dedup(frame).count() > len(got)


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 5, 31, 32, 33, 160, 200, 3000)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // k], rng.integers(0, 1 << 63, len(s) // k, dtype=np.uint64)])) for s in sets for k in (2, 9, 12)]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    found = simhash.sketch_distances([simhash.parity_sketch(s) for s in sets], left, right)
    for a, b, d in zip(left, right, found, strict=True):
        apart = len(np.setxor1d(sets[a], sets[b]))
        assert d <= apart and (d - apart) % 2 == 0
        assert a != b or d == 0


def test_keys_of_sets_are_not_gathered_on_the_driver(spark, sf_dir, monkeypatch):
    plans, materialize = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(plan_of(df)) or materialize(df))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < simhash.near_dedup(docs).count() < docs.count()
    # a row for each of a set's 40 keys, which Spark takes for one row a set
    keyed = [p for p in plans if "explode(keys" in p]
    assert keyed and not [p for p in keyed if "Broadcast" in p]


def test_near_copies_awkward_rows(spark, tricky, nothing):
    kept = simhash.near_dedup(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8, 9, 10]
    assert simhash.near_dedup(nothing).count() == 0


# --- lines ---------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs):
    out, seen = [], []
    for doc, text, _ in rows_of(docs):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = []
        for line in lines:
            if not line.strip(" "):
                kept.append(line)
                continue
            again = any(line == s or one_edit(line, s) for s in seen)
            seen.append(line)
            if not again:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcde ", k=rng.randint(15, 40))) for _ in range(30)]

    def edited(line):
        i = rng.randrange(len(line))
        return rng.choice([line, line[:i] + line[i + 1 :], line[:i] + "x" + line[i:], line[:i] + "y" + line[i + 1 :], line[:i] + "é" + line[i + 1 :]])

    docs = [(i, "\n".join(rng.choice([edited(rng.choice(base)), "", "  ", "short"]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in linededup.line_dedup(frame).select("doc_id", "text", "lines_total", "lines_dropped").collect())
    assert got == sorted(brute_lines(frame))


def test_short_lines_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, "\n".join("".join(rng.choices("abcé😀 ", k=rng.choice([0, 1, 2, 3, 5, 9, 18, 19, 20, 21]))) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in linededup.line_dedup(frame).select("doc_id", "text", "lines_total", "lines_dropped").collect())
    assert got == sorted(brute_lines(frame))


def test_a_document_of_many_lines(spark):
    """The work is linear in the lines of one document: the square of these would take hours."""
    lines = [f"{i % 100_000:09d} {(i % 100_000) * 7919 % 1_000_003:07d}" for i in range(200_000)]
    frame = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = linededup.line_dedup(frame, near=False).first()
    assert got["lines_total"] == 200_000 and got["lines_dropped"] == 100_000
    assert got["text"].split("\n") == lines[:100_000]


def test_long_lines_are_cut_into_parts(spark):
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefgh ", k=1501))
    docs = [(0, base), (1, base[:1000] + "X" + base[1001:]), (2, base[1:]), (3, base[:-1]), (4, base[:700] + base[701:]), (5, base[:700] + "ZZ" + base[700:]), (6, base + "!"), (7, base[:499] + base[500:])]
    huge = "".join(rng.choices("abcdefgh ", k=300_000))
    docs += [(8, huge), (9, huge[:123_456] + "?" + huge[123_456:]), (10, huge[:-2])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["lines_dropped"] for r in linededup.line_dedup(frame).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1, 7: 1, 8: 0, 9: 1, 10: 0}


def test_near_lines_are_not_gathered_on_the_driver(spark):
    docs = spark.range(200).select(F.col("id").alias("doc"), F.concat(F.lit("a line that is written "), F.col("id") % 50, F.lit(" times in all")).alias("body")).withColumn("text_key", F.xxhash64("body"))
    place = F.struct("doc", "text_key", "line_no")
    lines = linededup._lines(docs)
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.first("half_keys").alias("half_keys"))
    drops = linededup._near_drops(docs, firsts)
    # every variant of a line is a row of an explode, which Spark takes for one row a line
    assert drops.count() == 49 and "Generate" in plan_of(drops) and "Broadcast" not in plan_of(drops)


def test_only_hot_keys_are_broadcast(spark):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("k"))
    table = common.materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    joined = common.split_join(rows, table, ["k"], "n")
    assert joined.count() == 3000 and "Broadcast" not in plan_of(joined)


def test_lines_awkward_rows(spark, tricky, nothing):
    out = linededup.line_dedup(tricky)
    assert out.columns == [*tricky.columns, "lines_total_", "lines_dropped"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] is None and rows[1]["lines_total_"] == 0
    assert rows[8]["text"] == "a line that is long enough to count\nanother line that is also long"
    assert rows[9]["text"] == "something else that nobody wrote"
    assert rows[4]["text"] and rows[5]["text"] == "" and out.where("doc_id = 5").count() == 2
    assert out.count() == tricky.count() and linededup.line_dedup(nothing).count() == 0


# --- passages --------------------------------------------------------------------


def brute_repeats(docs, n):
    """{id: kept words} where a word goes if a window of n words around it occurred earlier."""
    out, seen = {}, set()
    for doc, text, _ in rows_of(docs):
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                gone.update(range(i, i + n))
            seen.add(window)
        out[doc] = [w for i, w in enumerate(words) if i not in gone]
    return out


def passages(rng):
    shared = [[f"s{k}x{i}" for i in range(rng.randint(8, 40))] for k in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(len(s))
                words += s[a : a + rng.randint(3, 40)]
            else:
                words += [rng.choice("abc") for _ in range(rng.randint(1, 15))]
        docs.append((i, " ".join(words)))
    return docs


def test_passages_against_brute_force(spark):
    for seed in range(3):
        frame = spark.createDataFrame(passages(random.Random(seed)), "doc_id long, text string")
        got = {r["doc_id"]: r["text"].split() for r in suffixes.remove_repeats(frame, words=10, prefix=4).collect()}
        assert got == brute_repeats(frame, 10)


def test_passages_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = suffixes.remove_repeats(docs).collect()
    assert {r["doc_id"]: r["text"].split() for r in rows} == brute_repeats(docs, 50)
    assert any(r["removed_words"] for r in rows)


def test_passages_awkward_rows(spark, tricky, nothing):
    out = suffixes.remove_repeats(tricky)
    assert out.columns == [*tricky.columns, "removed_", "removed_words", "first_docs"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] is None and rows[5]["text"] == "" and rows[5]["first_docs"] == [4]
    assert rows[6]["text"] == "Über ende 😀" and rows[6]["removed_words"] == 60
    assert out.count() == tricky.count() and suffixes.remove_repeats(nothing).count() == 0


def test_hot_prefixes_give_the_same(spark, monkeypatch):
    """With so low a bound that most prefixes count as hot, and windows in several turns."""
    frame = spark.createDataFrame(passages(random.Random(9)), "doc_id long, text string")
    cold = {r["doc_id"]: r for r in suffixes.remove_repeats(frame, words=10, prefix=4).collect()}
    monkeypatch.setattr(common, "HOT_SHARE", 10**6)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(frame, words=10, prefix=4).collect()}
    assert {d: r["text"].split() for d, r in got.items()} == brute_repeats(frame, 10)
    assert got == cold and sum(bool(r["first_docs"]) for r in got.values()) > 10


def test_first_documents_do_not_depend_on_what_counts_as_hot(spark, monkeypatch):
    """One prefix has nearly all suffixes of 400 documents: with the bound that runs it is hot, with the other none is."""
    rng = random.Random(11)
    shared = " ".join(f"s{k}" for k in range(60))
    docs = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(5)), shared, *(f"w{rng.randrange(10**6)}" for _ in range(5))])) for i in range(3, 403)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hot = {r["doc_id"]: r for r in suffixes.remove_repeats(frame).collect()}
    monkeypatch.setattr(common, "HOT_SHARE", 1)
    assert {r["doc_id"]: r for r in suffixes.remove_repeats(frame).collect()} == hot
    firsts = {tuple(r["first_docs"]) for d, r in hot.items() if d != 3}
    assert () not in firsts and len(firsts) <= 3 and (3,) in firsts


def test_long_texts_in_turns():
    rng = random.Random(10)
    giant = "x" * 5000 + " y " + "z" * 3001
    texts = [" ".join("w" * rng.randint(1, 30) for _ in range(3000)), giant, "a" * 4096, "  ", " b" * 3000 + " " * 700, ""]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        want = common.words_of(raw, np.array([0, len(raw)]))[2]
        for most in (64, 333, 1024):
            assert suffixes.long_hashes(raw, most).tolist() == want.tolist()
    text = " ".join(rng.choice("abcdef") * rng.randint(1, 5) for _ in range(300_000))
    column = pa.array([text])
    assert len(text) > common.CHUNK_BYTES
    windows = []
    for step in (7_001, 1 << 20):
        found = [np.arange(f, l + 1) * 2**24 + at for _, s in suffixes._each_chunk(column, 50, 8, step) for f, l, at in zip(s["first"], s["last"], s["at"], strict=True)]
        windows.append(np.concatenate(found))
    assert len(windows[0]) == 300_000 - 49 and windows[0].tolist() == windows[1].tolist()


def test_a_text_of_millions_of_words(spark):
    """17 million words: no text is too long. One passage of 60 words stands twice in it."""
    n = 17_000_000
    frame = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.when(i < n - 60, i).otherwise(i - n + 60).cast("string"), 10, 36)), " ").alias("text"))
    got = suffixes.remove_repeats(frame).select("removed", "removed_words", F.size(F.split("text", " ")).alias("left")).first()
    assert [tuple(r) for r in got["removed"]] == [(n - 60, n)] and got["removed_words"] == 60


@pytest.mark.parametrize("dedup", [simhash.simhash_dedup, simhash.near_dedup])
def test_columns_of_maps_pass_through(spark, dedup):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, {"a": 1, "b": 2}, [{"x": "y"}]), (1, text, {"b": 2, "a": 1}, [{"x": "y"}]), (2, text, None, None), (3, "something else altogether " * 9, {}, []), (None, text, {"z": 0}, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, n array<map<string, string>>")
    got = sorted(((r["doc_id"], r["m"]) for r in dedup(frame).collect()), key=str)
    assert got == sorted([(1, {"a": 1, "b": 2}), (3, {}), (None, {"z": 0})], key=str)
