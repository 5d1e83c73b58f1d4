import hashlib

import numpy as np

from ledgerline.llm import syncmers


def brute(docs):
    """(n_chars, sha of the edited text, fingerprint) per (id, text), in order."""
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode("utf-8")))
    out = []
    for i, (d, t) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        n = len(t) // 2
        edited = (t[: len(t) - n] + other[:n]).encode("utf-8")
        a, b, c = (syncmers.fingerprint(x) for x in (t.encode("utf-8"), edited, other.encode("utf-8")))
        out.append((d, len(t), hashlib.sha256(edited).hexdigest(), a, b, syncmers.likeness(a, b), syncmers.likeness(a, c)))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for parts in (1, 7):
        assert sorted((tuple(r) for r in syncmers.compare_with_next(docs, parts=parts).collect()), key=str) == want
    unlike = [r for r in want if r[6] < 0.5 and r[1] > 500]
    assert np.mean([r[5] for r in unlike]) > 0.2 and np.mean([r[6] for r in unlike]) < 0.05


def test_anchors_are_closed_syncmers_and_free_of_context():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 105, 400, dtype=np.uint8)
    at, hashes = syncmers.closed_syncmers(raw)
    inner = [syncmers._windows(raw[i : i + syncmers.S], syncmers.S)[0] for i in range(len(raw) - syncmers.S + 1)]
    want = []
    for i in range(len(raw) - syncmers.K + 1):
        own = inner[i : i + syncmers.K - syncmers.S + 1]
        if min(own) in (own[0], own[-1]):
            want.append(i)
    assert at.tolist() == want
    moved_at, moved = syncmers.closed_syncmers(np.concatenate([np.full(13, 120, np.uint8), raw]))
    assert set(zip((at + 13).tolist(), hashes.tolist(), strict=True)) <= set(zip(moved_at.tolist(), moved.tolist(), strict=True))
    assert np.diff(at).max() <= syncmers.K - syncmers.S


def test_likeness_estimates_shared_anchors():
    rng = np.random.default_rng(2)
    a, b = ("".join(rng.choice(list("abcdefgh "), 4000)) for _ in range(2))
    of = lambda t: syncmers.fingerprint(t.encode())
    assert syncmers.likeness(of(a), of(a)) == 1.0
    assert abs(syncmers.likeness(of(a), of(a[:2000] + b[:2000])) - 1 / 3) < 0.12
    assert syncmers.likeness(of(a), of(b)) < 0.03
    assert syncmers.likeness(of(""), of("")) == 1.0 and syncmers.likeness(of(""), of("x")) == 0.0


def test_awkward_rows(spark, tricky, nothing):
    rows = sorted((tuple(r) for r in syncmers.compare_with_next(tricky, parts=3).collect()), key=str)
    assert rows == brute([(r["doc_id"], r["text"]) for r in tricky.collect()])
    assert syncmers.compare_with_next(nothing).count() == 0
    one = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    assert syncmers.compare_with_next(one).first()["near_next"] == 1.0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert syncmers.compare_with_next(nulls).count() == 2
    assert syncmers.fingerprint_documents(tricky).columns == [*tricky.columns, "fingerprint_"]
    assert {r["doc"] for r in syncmers.anchors(tricky).collect()} == {r["doc_id"] for r in tricky.collect() if r["text"]}


def test_short_texts_have_an_anchor():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in range(24, 35) for _ in range(20)]
    prints = [syncmers.fingerprint(t) for t in texts]
    assert len(set(prints)) == len(set(texts)) and syncmers.fingerprint(b"") not in prints
    assert all(syncmers.likeness(p, syncmers.fingerprint(b"")) == 0.0 for p in prints)
    assert max(syncmers.likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)) < 1.0


MASK = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def plain_hash(data):
    """The hash of 12 bytes, from hashes of 4 and 8, byte by byte in whole numbers."""
    level = {i: b + 1 for i, b in enumerate(data)}
    join = lambda a, b: plain_mix((a * 0x9E3779B97F4A7C15 + b) & MASK)
    two = {i: join(level[i], level[i + 1]) for i in range(len(data) - 1)}
    four = {i: join(two[i], two[i + 2]) for i in range(len(data) - 3)}
    return join(four[0], join(four[4], four[8]))


def plain_fingerprint(data):
    """The fingerprint written from its definition, without numpy."""
    found = []
    for i in range(len(data) - 23):
        inner = [plain_hash(data[j : j + 12]) for j in range(i, i + 13)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, plain_mix((inner[0] * 0x9E3779B97F4A7C15 + inner[-1] + 24) & MASK)))
    if data and not found:
        found = [(0, int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little"))]
    slots = {}
    for at, h in found:
        slots[h % 128] = min(slots.get(h % 128, (MASK, 0)), (h >> 7, at))
    order = {slot: k for k, (_, slot) in enumerate(sorted((at, slot) for slot, (_, at) in slots.items()))}
    return "".join(f"{plain_mix(slots[s][0]) & 0xFFFF:04x}{order[s]:02x}" if s in slots else "------" for s in range(128))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    cells = [(a[i : i + 6], b[i : i + 6]) for i in range(0, 768, 6)]
    filled = [c for c in cells if c != ("------", "------")]
    same = sorted((x[4:], y[4:]) for x, y in filled if x[:4] == y[:4])
    best = []
    for k, (_, y) in enumerate(same):
        best.append(1 + max((best[j] for j in range(k) if same[j][1] < y), default=0))
    return max(best, default=0) / len(filled)


def test_fingerprints_by_definition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000").select("text").collect()
    texts = [b"", b"x", b"ab" * 40, b"a" * 23, b"a" * 24, *((r["text"] or "").encode() for r in rows[:60])]
    prints = [syncmers.fingerprint(t) for t in texts]
    assert prints == [plain_fingerprint(t) for t in texts]
    for a, b in zip(prints, prints[1:], strict=False):
        assert syncmers.likeness(a, b) == plain_likeness(a, b)


def test_shuffled_passages_are_less_alike():
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcdefgh "), 500)) for _ in range(8)]
    of = lambda p: syncmers.fingerprint("".join(p).encode())
    moved, back = syncmers.likeness(of(parts), of([*parts[1:], parts[0]])), syncmers.likeness(of(parts), of(parts[::-1]))
    assert moved > 0.75 and back < 0.35


def test_cuts_are_counted(spark):
    import bisect

    from pyspark.sql import functions as F

    for n in (1, 2, 5, 50):
        cuts = sorted(set(np.random.default_rng(n).integers(0, 200, n).tolist()))
        rows = spark.range(-1, 202).select("id", syncmers._not_above(cuts, F.col("id")).alias("k")).collect()
        assert all(r["k"] == bisect.bisect_right(cuts, r["id"]) for r in rows)
