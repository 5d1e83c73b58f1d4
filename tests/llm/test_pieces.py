import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerline.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def as_unigram(data: bytes) -> bytes:
    """The same pieces under a unigram model: a later field overrides the model type."""
    return data + b"\x12" + varint(2) + b"\x18\x01"


def random_texts(n):
    rng = random.Random(5)
    letters = [*"abtheingrs  \n\té漢😀.'0", "the", " in", "ing", "   "]
    return ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(n)]


def test_same_ids_and_texts_as_the_library(model, reference, spark, sf_dir):
    texts = random_texts(4000) + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    ids, first = model.encode(pa.array(texts))
    for k, t in enumerate(texts):
        want = reference.encode(t)
        assert ids[first[k] : first[k + 1]].tolist() == want
        assert model.decode(want) == reference.decode(want)


def test_borders_agree_with_plain_merging(model):
    rng = random.Random(2)
    ids = list(model.ids.values())
    for _ in range(5000):
        a, b = rng.choice(ids), rng.choice(ids[:3000])
        text = [model.pieces[a], model.pieces[b]]
        parts = list("".join(text))
        while True:
            ranks = [model.rank.get(x + y, 1e9) for x, y in zip(parts, parts[1:], strict=False)]
            if not ranks or min(ranks) == 1e9:
                break
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert model._may_follow(a, b) == (parts == text)


def test_unigram_viterbi_is_the_best_segmentation():
    with open(PATH, "rb") as f:
        data = as_unigram(f.read())
    # scores of a BPE file are ranks; the best sum is checked against all segmentations
    model = pieces.Pieces(data)
    model.model = pieces.UNIGRAM
    rng = random.Random(3)
    for _ in range(300):
        text = "▁" + "".join(rng.choices("theingras", k=rng.randint(1, 9)))

        def best(at, text=text):
            if at == len(text):
                return 0.0
            options = [model.scores[model.ids[text[at:e]]] + best(e) for e in range(at + 1, len(text) + 1) if text[at:e] in model.ids]
            return max(options, default=-1e9)

        ids = model.word(text)
        assert "".join(model.pieces[i] for i in ids) == text
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(0))


def test_round_trip_of_whole_documents(spark, sf_dir):
    rows = queries.op5_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == 200 and all(r["round_trip"] for r in rows)


def test_columns(spark, tricky, nothing):
    ids = tricky.select("text", pieces.encode_column(PATH)("text").alias("ids"))
    rows = ids.select("text", "ids", pieces.decode_column(PATH)("ids").alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows)
    out = pieces.code_documents(tricky, PATH)
    assert out.columns == ["doc_id", "n_ids", "ids_crc32", "round_trip"] and out.count() == tricky.count()
    assert out.where("doc_id in (1, 2)").agg(F.sum("n_ids"), F.max("ids_crc32")).first()[:] == (0, 0)
    assert pieces.code_documents(nothing, PATH).count() == 0


def test_forgetting_changes_nothing(model, monkeypatch):
    texts = pa.array(random_texts(200))
    want = model.encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    got = model.encode(texts)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
