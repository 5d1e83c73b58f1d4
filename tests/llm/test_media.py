import hashlib
import random
import zlib

import pytest

from ledgerline.llm import media, queries


def test_every_document_is_read_back(spark, sf_dir):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        stored = media.write_samples(payload)
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for _ in range(50):
        n = 1 if not lacing else rng.randint(1, 40)
        size = rng.randint(0, 600)
        frames = [bytes(rng.choices(range(256), k=size if lacing == 2 else rng.choice([0, 5, 255, 510, rng.randint(0, 20_000)]))) for _ in range(n)]
        block = media.element(media.SIMPLE_BLOCK, media.laced_block(frames, 3, -7, lacing))
        cluster = media.element(media.CLUSTER, media.number(media.TIMESTAMP, 100) + block)
        file = media._HEAD + media.element(media.SEGMENT, cluster)
        found = media.parse(file)
        assert [file[p[2] : p[2] + p[3]] for p in found.packets] == frames
        assert {(p[0], p[1]) for p in found.packets} == {(3, 93_000_000)}


def test_unknown_sizes_block_groups_and_cues():
    frame = bytes(range(200))
    unknown = b"\x01" + b"\xff" * 7
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.laced_block([frame], 1, 5, 0)) + media.number(media.REFERENCE_BLOCK, 1))
    cluster = media.CLUSTER.to_bytes(4, "big") + unknown + media.number(media.TIMESTAMP, 10) + group
    point = media.element(media.CUE_POINT, media.number(media.CUE_TIME, 10) + media.element(media.CUE_TRACK_POSITIONS, media.number(media.CUE_TRACK, 1) + media.number(media.CUE_CLUSTER_POSITION, 0)))
    file = media._HEAD + media.SEGMENT.to_bytes(4, "big") + unknown + cluster + cluster + media.element(media.CUES, point)
    found = media.parse(file)
    assert [(p[0], p[1], p[3], p[4]) for p in found.packets] == [(1, 15_000_000, 200, False)] * 2
    ((time, track, byte),) = found.cues
    assert (time, track) == (10_000_000, 1) and file[byte : byte + 4] == media.CLUSTER.to_bytes(4, "big")


def test_times_and_cues_of_long_payloads():
    payload = bytes(192 * 3000)
    file = media.write_samples(payload)
    found = media.parse(file)
    assert [p[1] for p in found.packets] == [k * 24_000_000 for k in range(3000)]
    assert len(found.cues) == 3 and all(file[b : b + 4] == media.CLUSTER.to_bytes(4, "big") for _, _, b in found.cues)
    assert media.read_samples(file) == payload


def test_awkward_rows(spark, tricky, nothing):
    stored = media.media_documents(tricky)
    assert stored.columns == ["doc_id", "n_bytes", "media"] and stored.count() == tricky.count()
    assert media.media_documents(nothing).count() == 0
    packets = media.media_packets(stored).where("doc = 2").collect()
    assert [(p["packet"], p["track"], p["time_ns"], p["bytes"], p["error"]) for p in packets] == [(0, 1, 0, 192, None)]
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"\x1a\x45"), (4, media.write_samples(bytes(192))[:-40])], "doc_id int, media binary")
    rows = media.media_packets(bad).collect()
    assert [r["doc"] for r in rows] == [1, 2, 3, 4] and all(r["error"] for r in rows)
