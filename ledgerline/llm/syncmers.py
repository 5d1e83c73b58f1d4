"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the first or the last one of its inner
s-mers is as small (by hash) as any of them. Whether it is depends on its own
bytes alone, so equal passages carry equal anchors at equal relative places, and
every window of k - s k-mers has an anchor. ``anchors`` returns those of a text
with their places. ``fingerprint`` keeps the smallest anchor in each of ``SLOTS``
slots, its hash and its rank by place among those kept. The likeness of two
fingerprints matches by position: of the slots with equal anchors the longest
chain that stands in the same order in both counts, as a share of the slots
filled in either. Where equal passages keep their order this estimates the
Jaccard similarity of anchor sets; passages that were shuffled count once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import fresh, mix, utf8

K, S = 24, 12
SLOTS, SLOT_BITS, WIDE = 128, 16, 6
#: A range of neighbouring documents holds about so many bytes; there are at most MOST_PARTS ranges, which the quantiles still tell apart.
PART_BYTES, MOST_PARTS = 64 << 20, 10_000
_EMPTY = np.uint64((1 << 64) - 1)
_B = np.uint64(0x9E3779B97F4A7C15)


def _windows(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes in a row, by doubling."""
    out, have, at = None, 0, raw.astype(np.uint64) + np.uint64(1)
    reach = 1
    while reach <= width:
        if width & reach:
            out = at if out is None else mix(out[: len(at) - have] * _B + at[have:]) if len(at) > have else at[:0]
            have += reach
        if 2 * reach <= width:
            at = mix(at[:-reach] * _B + at[reach:]) if len(at) > reach else at[:0]
        reach *= 2
    return out[: max(0, len(raw) - width + 1)]


def _whole(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One anchor for all bytes of a text."""
    return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "<u8").astype(np.uint64)


def closed_syncmers(raw: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of one text's bytes; a text without any (of under k bytes, or of few k-mers) is one anchor as a whole, an empty one none."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < k:
        return _whole(raw)
    inner = _windows(raw, s)
    width = k - s + 1
    least, reach = inner, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    m = n - k + 1
    at = np.flatnonzero((inner[:m] == least) | (inner[k - s : k - s + m] == least))
    if not len(at):
        return _whole(raw)
    return at, mix(inner[at] * _B + inner[at + k - s] + np.uint64(k))


def sketch(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of each slot (``_EMPTY`` in slots without any) and the first place where it stands."""
    out, place = np.full(SLOTS, _EMPTY), np.full(SLOTS, np.iinfo(np.int64).max)
    slot, rest = (hashes & np.uint64(SLOTS - 1)).astype(np.int64), hashes >> np.uint64(7)
    np.minimum.at(out, slot, rest)
    kept = out[slot] == rest
    np.minimum.at(place, slot[kept], at[kept])
    return out, place


def text_form(slots: np.ndarray, place: np.ndarray) -> str:
    """Six hex digits per slot, four of the anchor and two of its rank by place; ``------`` for an empty one."""
    rank = np.empty(SLOTS, np.uint64)
    rank[np.argsort(place, kind="stable")] = np.arange(SLOTS, dtype=np.uint64)
    short = ((mix(slots) & np.uint64((1 << SLOT_BITS) - 1)) << np.uint64(8) | rank).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
    empty = slots == _EMPTY
    return short if not empty.any() else "".join("-" * WIDE if e else short[WIDE * i : WIDE * (i + 1)] for i, e in enumerate(empty.tolist()))


def _chain(x: list[str], y: list[str]) -> int:
    """Length of the longest chain of pairs that rise in both."""
    ends: list[str] = []
    for _, rank in sorted(zip(x, y, strict=True)):
        i = bisect_left(ends, rank)
        ends[i : i + 1] = [rank]
    return len(ends)


def likeness(a: str, b: str) -> float:
    """Share of slots in the longest chain of equal anchors in equal order, among those filled in either; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    cells = [(a[i : i + WIDE], b[i : i + WIDE]) for i in range(0, len(a), WIDE)]
    filled = [(x, y) for x, y in cells if x[0] != "-" or y[0] != "-"]
    same = [(x[4:], y[4:]) for x, y in filled if x[:4] == y[:4]]
    return _chain([x for x, _ in same], [y for _, y in same]) / len(filled)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes."""
    return text_form(*sketch(*closed_syncmers(np.frombuffer(data, np.uint8))))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for i in range(batch.num_rows):
            at, hashes = closed_syncmers(raw[offsets[i] : offsets[i + 1]])
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at), pa.array(hashes.view(np.int64))], names=["doc", "byte", "anchor"])


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, byte, anchor): every anchor of every whole text with its byte place; null and empty texts have none."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("byte", T.LongType()), T.StructField("anchor", T.LongType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_anchor_rows, schema)


# --- each document, its edited text and the next document -----------------------


def _half(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the other text."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, then in document order; the last of a part is the next part's first (a guest), which gets no row."""
    held, out = None, []

    def flush() -> pa.RecordBatch:
        names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], None if i else doc_type) for i in range(len(names))], names=names)

    for batch in batches:
        doc_type = batch.schema.field(1).type
        for part, doc, guest, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            now = (part, doc, text, fingerprint(text.encode("utf-8")))
            if held is not None and held[0] == part:
                edited = _half(held[2], text).encode("utf-8")
                own, other = held[3], fingerprint(edited)
                out.append((held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, now[3])))
            held = None if guest else now
        if out:
            yield flush()
            out = []


def _not_above(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are not above a value: the block of cuts is found first, then the place in it."""
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    count = lambda held: F.size(F.filter(held, lambda c: c <= value))
    k = count(F.lit([b[0] for b in blocks]))
    return F.when(k == 0, 0).otherwise((k - 1) * wide + count(F.get(F.lit(blocks), k - 1)))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text takes the second half (floor of n/2 code points) from the
    start of the next document: descending id, then text; null ids come last;
    after the last comes the first. A single document is its own next. Ids are
    integers. A null text counts as empty. Repeated rows follow one another and
    all stay. Columns: the id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next; others are left out. An empty
    table gives no rows.

    Rows are dealt into ranges of ids that a quantile sketch bounds, of about
    PART_BYTES each (rows of one id are in one range). Each range
    gets one guest, the first row of the next range, so a single sorted pass
    meets every pair of neighbours and no task holds more than its stream.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES))
    bounds = rows.agg(F.percentile_approx("doc", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(bounds))
    # descending ids: range 0 holds the largest; null ids are in the last
    place = len(cuts) - _not_above(cuts, F.col("doc")) if cuts else F.lit(0)
    place = F.when(F.col("doc").isNull(), F.lit(len(cuts))).otherwise(place)
    rows = rows.select(place.alias("part"), "doc", "body")
    # the first row of each range: one per range, so as many as there are parts
    heads = rows.groupBy("part").agg(F.max("doc").alias("head")).collect()
    if not heads:
        return rows.select(F.col("doc").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in _SHAPE)).where("false")
    order = [r["part"] for r in sorted(heads, key=lambda r: r["part"])]
    head_of = {r["part"]: r["head"] for r in heads}
    goes_to = {order[(i + 1) % len(order)]: p for i, p in enumerate(order)}
    wanted = spark.createDataFrame([(p, head_of[p], goes_to[p]) for p in order], T.StructType([T.StructField("p", T.IntegerType()), T.StructField("h", docs.schema[id_col].dataType), T.StructField("to", T.IntegerType())]))
    first = rows.join(F.broadcast(wanted), (F.col("part") == F.col("p")) & F.col("doc").eqNullSafe(F.col("h")))
    guests = first.groupBy("to").agg(F.min(F.struct("doc", "body")).alias("g"))
    guests = guests.select(F.col("to").alias("part"), F.col("g.doc").alias("doc"), F.lit(True).alias("guest"), F.col("g.body").alias("body"))
    both = rows.select("part", "doc", F.lit(False).alias("guest"), "body").unionByName(guests)
    dealt = both.repartitionByRange(len(order), "part").sortWithinPartitions("part", "guest", F.col("doc").desc_nulls_last(), "body")
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType)] + [T.StructField(c, T._parse_datatype_string(t)) for c, t in _SHAPE])
    return dealt.mapInArrow(_compared, schema).withColumnRenamed("doc", id_col)


_SHAPE = [("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (an underscore appended to a name already taken). Null texts count as empty; equal texts have equal fingerprints."""

    @F.arrow_udf("string")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint((t or "").encode("utf-8")) for t in text.to_pylist()])

    return docs.withColumn(fresh(docs, "fingerprint"), of(F.col(text_col).cast("string")))
