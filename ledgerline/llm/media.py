"""Matroska media columns: a writer for sample payloads and a parser that yields packet tables.

The parser walks EBML elements (variable-length ids and sizes, unknown sizes
included), clusters, simple blocks and block groups, undoes no, Xiph, fixed-size and
EBML lacing, and reads cues. A packet is a track, a time, and a byte range of the
stored file, so that any packet can be fetched alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: element ids of the Matroska format
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

FRAME = 192
RATE = 8000
FRAME_MS = 1000 * FRAME // RATE
LACED = 8
CLUSTER_FRAMES = 1280


# --- writing ---------------------------------------------------------------------


def vint(value: int, least: int = 1) -> bytes:
    """A size as a variable-length number."""
    n = least
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced_block(frames: list[bytes], track: int, time: int, lacing: int, key: bool = True) -> bytes:
    """The contents of a simple block; lacing: 0 none (one frame), 1 Xiph, 2 fixed-size, 3 EBML."""
    head = vint(track) + time.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])
    if not lacing:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3 and len(frames) > 1:
        head += vint(sizes[0])
        for before, n in zip(sizes[:-1], sizes[1:-1], strict=False):
            step, width = n - before, 1
            while not -(1 << 7 * width - 1) < step < (1 << 7 * width - 1):
                width += 1
            head += (step + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


_HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
_INFO = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"ledgerline") + element(WRITING_APP, b"ledgerline"))
_AUDIO = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + _AUDIO))


def payload_of(text: bytes) -> bytes:
    """The bytes with spaces after them, up to a positive multiple of FRAME."""
    return text + b" " * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def write_samples(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of 8-bit samples: frames of FRAME samples, up to LACED to a block, and a cue per cluster."""
    frames = len(payload) // FRAME
    parts = [_INFO, _TRACKS]
    at, cues = len(_INFO) + len(_TRACKS), []
    for c in range(0, frames, CLUSTER_FRAMES):
        blocks = [number(TIMESTAMP, c * FRAME_MS)]
        past = min(frames, c + CLUSTER_FRAMES)
        for b in range(c, past, LACED):
            n = min(LACED, past - b)
            lace = bytes([0x84, n - 1]) if n > 1 else b"\x80"
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + ((b - c) * FRAME_MS).to_bytes(2, "big") + lace + payload[b * FRAME : (b + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# --- parsing ---------------------------------------------------------------------


class Malformed(ValueError):
    """The bytes are no well-formed file of this format."""


@dataclass
class Parsed:
    """Packets (track, time in ns, first byte, bytes, key frame, block) and cues (time in ns, track, byte of the cluster)."""

    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    blocks: int = 0


def _read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """Value, place after it, and whether all its bits are set (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Malformed(f"a number cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    bits = (1 << 7 * n) - 1
    return (value if keep_mark else value & bits), at + n, value & bits == bits


def elements(data: bytes, at: int, past: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, first byte of the contents, byte past them, size unknown) of consecutive elements."""
    while at < past:
        kind, at, _ = _read_vint(data, at, True)
        size, at, unknown = _read_vint(data, at)
        end = past if unknown else at + size
        if end > past:
            raise Malformed(f"element {kind:x} at byte {at} goes beyond what holds it")
        yield kind, at, end, unknown
        at = end


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(data: bytes, at: int, end: int, base: int, out: Parsed, key: bool | None) -> None:
    track, at, _ = _read_vint(data, at)
    if at + 3 > end:
        raise Malformed(f"a block cut off at byte {at}")
    time, flags = base + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    sizes: list[int] = []
    if lacing:
        if at >= end:
            raise Malformed(f"no lace count at byte {at}")
        n, at = data[at] + 1, at + 1
        if lacing == 2:
            if (end - at) % n:
                raise Malformed(f"fixed-size lacing that doesn't divide at byte {at}")
            sizes = [(end - at) // n] * n
        elif lacing == 1:
            for _ in range(n - 1):
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise Malformed(f"lace sizes cut off at byte {at}")
                size, at = size + data[at], at + 1
                sizes.append(size)
        else:
            for i in range(n - 1):
                width = 9 - data[at].bit_length() if at < end else 0
                value, at, _ = _read_vint(data, at)
                sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
        if lacing != 2:
            sizes.append(end - at - sum(sizes))
    else:
        sizes = [end - at]
    if min(sizes) < 0:
        raise Malformed(f"laces beyond their block at byte {at}")
    step = int(out.tracks.get(track, {}).get("duration") or 0)
    key = bool(flags & 0x80) if key is None else key
    for i, size in enumerate(sizes):
        out.packets.append((track, time * out.scale + i * step, at, size, key, out.blocks))
        at += size
    out.blocks += 1


def _cluster(data: bytes, at: int, end: int, unknown: bool, out: Parsed) -> int:
    base, before = 0, at
    for kind, a, b, _ in elements(data, at, end):
        if unknown and kind in _TOP:  # the next element of the segment ends a cluster of unknown size
            return before
        before = b
        if kind == TIMESTAMP:
            base = _uint(data, a, b)
        elif kind == SIMPLE_BLOCK:
            _block(data, a, b, base, out, None)
        elif kind == BLOCK_GROUP:
            inner = list(elements(data, a, b))
            key = all(k != REFERENCE_BLOCK for k, *_ in inner)
            for k, x, y, _ in inner:
                if k == BLOCK:
                    _block(data, x, y, base, out, key)
    return end


def _segment(data: bytes, at: int, end: int, out: Parsed) -> None:
    first, cues = at, []
    while at < end:
        kind, a, b, unknown = next(elements(data, at, end))
        at = b
        if kind == INFO:
            for k, x, y, _ in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    out.scale = _uint(data, x, y)
        elif kind == TRACKS:
            for k, x, y, _ in elements(data, a, b):
                if k == TRACK_ENTRY:
                    inside = {i: data[p:q] for i, p, q, _ in elements(data, x, y)}
                    out.tracks[int.from_bytes(inside.get(TRACK_NUMBER, b""), "big")] = {
                        "codec": inside.get(CODEC_ID, b"").decode("ascii", "replace"), "kind": int.from_bytes(inside.get(TRACK_TYPE, b""), "big"),
                        "duration": int.from_bytes(inside.get(DEFAULT_DURATION, b""), "big"),
                    }
        elif kind == CLUSTER:
            at = _cluster(data, a, b, unknown, out)
        elif kind == CUES:
            cues.append((a, b))
    for a, b in cues:
        for k, x, y, _ in elements(data, a, b):
            if k == CUE_POINT:
                inner = list(elements(data, x, y))
                time = next((_uint(data, p, q) for i, p, q, _ in inner if i == CUE_TIME), 0)
                for i, p, q, _ in inner:
                    if i == CUE_TRACK_POSITIONS:
                        at_track = {j: _uint(data, r, s) for j, r, s, _ in elements(data, p, q)}
                        out.cues.append((time * out.scale, at_track.get(CUE_TRACK, 0), first + at_track.get(CUE_CLUSTER_POSITION, 0)))


def parse(data: bytes) -> Parsed:
    """Packets and cues of a file; raises Malformed."""
    out, seen = Parsed(), False
    for kind, a, b, _ in elements(data, 0, len(data)):
        if not seen and kind != EBML:
            raise Malformed("no EBML header")
        seen = True
        if kind == SEGMENT:
            _segment(data, a, b, out)
    if not seen:
        raise Malformed("no bytes")
    return out


def read_samples(data: bytes, parsed: Parsed | None = None) -> bytes:
    """The packets' bytes in file order."""
    view = memoryview(data)
    return b"".join(view[p[2] : p[2] + p[3]] for p in (parsed or parse(data)).packets)


def feature_of(parsed: Parsed, samples: bytes) -> str:
    """Counts of packets, blocks and cues, the last packet's time in ms, and mean, spread and mean step of the samples in thousandths."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n = max(1, len(x))
    mean = int(x.sum()) * 1000 // n
    spread = int((x * x).sum()) * 1000 // n - mean * mean // 1000
    step = int(np.abs(np.diff(x)).sum()) * 1000 // n
    last = max((p[1] for p in parsed.packets), default=0) // 1_000_000
    return f"packets={len(parsed.packets)};blocks={parsed.blocks};cues={len(parsed.cues)};last_ms={last};mean={mean};spread={spread};step={step}"


# --- columns -----------------------------------------------------------------------


@F.arrow_udf(T.BinaryType())
def text_media(text: pa.Array) -> pa.Array:
    """Each text's padded UTF-8 bytes as a media file; null counts as empty."""
    return pa.array([write_samples(payload_of((t or "").encode("utf-8"))) for t in text.to_pylist()], pa.binary())


_READ = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


@F.arrow_udf(_READ)
def media_facts(media: pa.Array) -> pa.Array:
    """What a stored file holds, read back from its packets."""
    rows = []
    for data in media.to_pylist():
        parsed = parse(data)
        samples = read_samples(data, parsed)
        rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(parsed, samples)))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_READ.names)


def media_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a media file. Null texts count as empty; all rows stay, an empty table gives no rows, other columns are left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), text_media(text).alias("media"))


def _packet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "packet", "track", "time_ns", "byte", "bytes", "key_frame", "error"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    for batch in batches:
        for i, data in enumerate(batch.column(1)):
            try:
                found = [(n, p[0], p[1], p[2], p[3], p[4], None) for n, p in enumerate(parse(data.as_py()).packets)] if data.is_valid else [(None,) * 6 + ("null",)]
            except Malformed as error:
                found = [(None,) * 6 + (str(error),)]
            columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), *columns], names=names)


def media_packets(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc, packet, track, time_ns, byte, bytes, key_frame, error): the packet table of every file.

    A file that is null or malformed has one row with ``error`` set and nulls
    beside it; a well-formed file without packets has none.
    """
    schema = f"doc {files.schema[id_col].dataType.simpleString()}, packet int, track int, time_ns long, byte long, bytes long, key_frame boolean, error string"
    return files.select(id_col, F.col(media_col).cast(T.BinaryType())).mapInArrow(_packet_rows, schema)
