"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a word once; at each byte its output links give every piece
that ends there, and each of them may relax the best segmentation up to that
place. What "best" means depends on the model file: for a unigram model the sum
of piece scores is the greatest (Viterbi); for a BPE model a piece may follow
another if merging their letters by rank yields exactly these two, and at each
place exactly one piece ends a segmentation of which all neighbours are so. Text
that no piece covers becomes byte pieces, or the unknown piece.

Pieces reach over a word's start only as runs of spaces, so words are
encoded alone and each distinct word of a batch once.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import BYTE_POWERS, chunks, utf8
from ledgerline.llm.tokens import ragged

SPACE = "▁"
#: Kinds of pieces and models in model files.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: an unknown character scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Words that a Python worker remembers at a time; beyond it the memory starts anew.
REMEMBERED = 800_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protocol buffer message: bytes for lengths, int for varints, float for 32-bit values."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = float(np.frombuffer(data[at : at + size], "<f4" if size == 4 else "<f8")[0]), at + size
        yield key >> 3, value


class Pieces:
    """The pieces of a model file and the automaton over them."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, self.byte_fallback, self.add_prefix, self.squeeze = UNIGRAM, False, True, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode("utf-8"))
                self.scores.append(f.get(2, 0.0))
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.model, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("character maps of a normaliser are not supported")
                self.add_prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if self.model not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.byte_fallback else []
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that reach over the start of a word are not supported")
        if self.model == BPE:
            self._trace()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.fits: dict[tuple[int, int], bool] = {}
        self.spoken = [self._spoken(i) for i in range(len(self.pieces))]
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.first, self.count, self.flat = array("q"), array("q"), array("i")

    def _spoken(self, i: int) -> str:
        """What a piece adds to a text; bytes beyond ASCII stand for themselves as escapes until whole texts are known."""
        if self.kinds[i] == BYTE:
            b = int(self.pieces[i][3:5], 16)
            return chr(b) if b < 128 else chr(0xDC00 + b)
        return " ⁇ " if i == self.unknown else "" if self.kinds[i] == CONTROL else self.pieces[i].replace(SPACE, " ")

    def _trace(self) -> None:
        """Keep the pieces that merging their own letters gives, and note for both edges of each how they grew: (part, rank at which it is absorbed)."""
        order = sorted(self.ids.values(), key=lambda i: (-self.scores[i], i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.left: dict[int, list[tuple[str, float]]] = {}
        for p, i in list(self.ids.items()):
            parts, right, left, latest = list(p), [], [], -1
            while len(parts) > 1:
                ranks = [self.rank.get(x + y, math.inf) for x, y in zip(parts, parts[1:], strict=False)]
                rank = min(ranks)
                if rank == math.inf:
                    break
                at = ranks.index(rank)
                latest = max(latest, rank)  # a merge that another one makes possible comes right after it
                if at == len(parts) - 2:
                    right.append((parts[-1], latest))
                if at == 0:
                    left.append((parts[0], latest))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts == [p]:
                self.right[i], self.left[i] = [*right, (p, math.inf)], [*left, (p, math.inf)]
            else:
                del self.ids[p]

    # --- one word -----------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Letters of ``text`` merged by rank, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                whole = self.ids.get(parts[i] + parts[i + 1])
                if whole is not None and self.scores[whole] > best:
                    best, at = self.scores[whole], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging the letters of both pieces yields these two: no parts that meet at the border at any time merge before one of them is absorbed."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            a, b = self.right[left], self.left[right]
            i = j = 0
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                across = self.rank.get(x + y, math.inf)
                if across < x_until and across <= y_until and across < math.inf:  # of equal ranks the leftmost goes first
                    found = False
                    break
                if x_until == y_until == math.inf:
                    found = True
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.fits[left, right] = found
        return found

    def word(self, text: str) -> list[int]:
        """Ids of one word by a single pass over the automaton's outputs."""
        n = len(text)
        best = [-math.inf] * (n + 1)
        last: list[int] = [-1] * (n + 1)
        best[0] = 0.0
        reached = 0
        by_rank = self.model == BPE

        def close(upto: int) -> None:
            """Characters that no piece ends at become unknown ones."""
            nonlocal reached
            while reached < upto:
                reached += 1
                score = best[reached - 1] + self.unknown_score
                if score > best[reached] and (not by_rank or last[reached] < 0):
                    best[reached], last[reached] = score, self.unknown

        for end, (size, piece) in self.automaton.iter(text):
            close(end)
            past = end + 1
            start = past - size
            if best[start] == -math.inf:
                continue
            if by_rank:
                before = last[start]
                if before < 0 or before == self.unknown or self._may_follow(before, piece):
                    if last[past] < 0 or last[past] == self.unknown:
                        best[past], last[past] = 0.0, piece
            elif best[start] + self.scores[piece] > best[past]:
                best[past], last[past] = best[start] + self.scores[piece], piece
        close(n)
        out: list[int] = []
        at = n
        while at:
            piece = last[at]
            if piece == self.unknown:
                if self.byte_fallback:
                    out.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8")))
                elif not out or out[-1] != self.unknown:
                    out.append(piece)  # unknown neighbours are one piece
                at -= 1
            else:
                out.append(piece)
                at -= len(self.pieces[piece])
        return out[::-1]

    # --- whole texts --------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The text with spaces as the model has them."""
        if self.squeeze:
            text = " ".join(t for t in text.split(" ") if t)
        if not text:
            return ""
        return (SPACE if self.add_prefix else "") + text.replace(" ", SPACE)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text and the first id's place of each (one more at the end)."""
        if len(self.rows) > REMEMBERED:
            self.forget()
        texts = [self.normal(t or "") for t in column.to_pylist()]
        raw, offsets = utf8(pa.array(texts, pa.large_string()))
        n = len(raw)
        mark = np.zeros(n + 1, bool)  # bytes at which a space mark starts
        if n > 2:
            mark[: n - 2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        after = np.zeros(n + 1, bool)
        after[3:] = mark[: n - 2] if n > 2 else False
        cut = mark & ~after
        cut[offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], n].astype(np.int64)
        keys, where, back = np.unique(BYTE_POWERS.slices(BYTE_POWERS.sums(raw.astype(np.uint64) + np.uint64(1)), starts, ends), return_index=True, return_inverse=True)
        data = raw.tobytes()
        place = []
        for k, a, b in zip(keys.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True):
            row = self.rows.get(k)
            if row is None:
                ids = self.word(data[a:b].decode("utf-8"))
                row = self.rows[k] = len(self.first)
                self.first.append(len(self.flat))
                self.count.append(len(ids))
                self.flat.extend(ids)
            place.append(row)
        rows = np.array(place, np.int64)
        first, count = (np.frombuffer(x, np.int64)[rows] if len(rows) else rows for x in (self.first, self.count))
        own = np.frombuffer(self.flat, np.int32)[ragged(first, count)] if len(self.flat) else np.zeros(0, np.int32)
        begin = np.cumsum(count) - count
        lengths = count[back]
        return own[ragged(begin[back], lengths)], np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, offsets)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces in a row are UTF-8, what isn't valid there U+FFFD; control pieces are nothing."""
        text = "".join(map(self.spoken.__getitem__, ids))
        if self.byte_fallback and not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


_COLUMNS = [("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType())]


def encode_column(path: str):
    """A column function: the ids of a text (null for null). ``path`` is the model file's on every executor."""

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        found, first = load(path).encode(text)
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found), mask=pa.compute.is_null(text) if text.null_count else None)

    return ids


def decode_column(path: str):
    """A column function: the text of an array of ids (null for null)."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        pieces = load(path)
        return pa.array([None if i is None else pieces.decode(i) for i in ids.to_pylist()], pa.string())

    return text


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            column = batch.column(1)
            for a, b in chunks(utf8(column)[1]):
                part = column.slice(a, b - a)
                found, first = pieces.encode(part)
                data = memoryview(found.astype("<u4")).cast("B")
                edges = first.tolist()
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(edges, edges[1:], strict=False)]
                ids = found.tolist()
                same = []
                for s, e, text in zip(edges, edges[1:], part.to_pylist(), strict=False):
                    back = pieces.decode(ids[s:e])
                    normal = pieces.normal(text or "").replace(SPACE, " ")
                    same.append(back == (normal[1:] if pieces.add_prefix else normal))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(same)], names=["doc", *(n for n, _ in _COLUMNS)])

    return run


def code_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, round_trip) of every whole text: its number of ids, the CRC-32 of the ids as little-endian 32-bit numbers, and whether decoding them gives the normalised text.

    A null text counts as empty and has no ids. All rows stay; an empty table gives no rows; other columns are left out.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in _COLUMNS)])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_coded(model), schema).withColumnRenamed("doc", id_col)
