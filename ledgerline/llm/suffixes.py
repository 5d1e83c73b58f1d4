"""Removal of repeated passages with sparse suffix arrays.

A suffix starts at a minimiser: among the 8-word prefixes inside each window
of 50 words, the one with the smallest hash (the leftmost of equals). The words
alone choose it, so a passage of 50 words carries the same suffixes wherever it
stands, while about one position in 22 is kept.

1. Suffixes are sorted by prefix, then by all the words that the windows around
   them cover, then by place, so that equal ones are neighbours. The first of a
   run stays; for the others all these windows are repeats.
2. Where neighbours share the prefix but part somewhere around it, the match is
   extended to the left and right: the windows of the suffix, which reach up to
   42 words to its left and 50 to its right, are sorted under the prefix in the
   same way and compared with their neighbours, so that a match ends at the
   exact word at which the texts part.

Words, prefixes and windows are compared by hashes of 64 bits, windows within
one prefix only. Both sorts are window functions over the prefix. Prefixes that
over one in 500 suffixes share (found by a sketch, so under 1,000) would fill a
task: they are sorted in parts first, and the first suffix of every part's runs is
sorted once more with those of the other parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import BYTE_POWERS, CHUNK_BYTES, WORD_POWERS, WORD_SPACE, chunks, fresh, heavy_keys, materialize, mix, utf8, words_of

MIN_WORDS = 50
PREFIX = 8
#: So many windows of one text are looked at together; a place among them fits into the low bits of a hash.
STEP = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def sparse_suffixes(hashes: np.ndarray, first_word: np.ndarray, words: int = MIN_WORDS, prefix: int = PREFIX) -> dict[str, np.ndarray]:
    """The suffixes of consecutive texts, given the hashes of under 2**24 words.

    Each has its text, its place ``at``, the first and last start of the windows
    that chose it (places in the text) and hashes of its prefix and of all words
    of these windows.
    """
    n = len(hashes)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "at", "first", "last", "key", "span", "base")} | {"sums": np.zeros(1, np.uint64)}
    if n < words:
        return empty
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    sums = WORD_POWERS.sums(hashes)
    start = np.arange(n - prefix + 1)
    prefixes = WORD_POWERS.slices(sums, start, start + prefix)
    least = _sliding_least((prefixes & ~_PLACE) | start.astype(np.uint64), words - prefix + 1)
    at = (least & _PLACE).astype(np.int64)
    window = np.flatnonzero(text[: n - words + 1] == text[words - 1 :])
    if not len(window):
        return empty
    at = at[window]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    first, last, at = window[new], window[np.r_[new[1:], len(window)] - 1], at[new]
    span = mix(WORD_POWERS.slices(sums, first, last + words) ^ ((at - first).astype(np.uint64) << np.uint64(8)) ^ (last - first).astype(np.uint64))
    base = first_word[text[at]]
    return {"text": text[at], "at": at - base, "first": first - base, "last": last - base, "key": prefixes[at].view(np.int64), "span": span.view(np.int64), "base": base, "sums": sums}


def long_hashes(raw: np.ndarray, most: int = CHUNK_BYTES) -> np.ndarray:
    """The hashes of one text's words, from about ``most`` bytes at a time; a longer word is summed up in parts."""
    out, at = [], 0
    while at < len(raw):
        past = min(at + most, len(raw))
        spaces = np.flatnonzero(WORD_SPACE[raw[at:past]])
        if past < len(raw) and len(spaces):
            past = at + int(spaces[-1]) + 1
        elif past < len(raw):  # one word fills all of it
            total = 0
            while at < len(raw) and len(part := raw[at : at + most]):
                ends = np.flatnonzero(WORD_SPACE[part])
                part = part[: ends[0]] if len(ends) else part
                total += int(BYTE_POWERS.sums(part.astype(np.uint64) + np.uint64(1))[-1]) * pow(BYTE_POWERS.base, at - (past - most), 1 << 64)
                at += len(part)
                if len(ends):
                    break
            out.append(mix(np.array([total & (1 << 64) - 1], np.uint64)))
            continue
        out.append(words_of(raw[at:past], np.array([0, past - at]))[2])
        at = past
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _each_chunk(column: pa.Array, words: int, prefix: int, step: int = STEP):
    """(first row, suffixes) of a batch's texts; a long text comes in several turns, each with all windows that start in it."""
    raw, offsets = utf8(column)
    for a, b in chunks(offsets):
        low = offsets[a]
        if b > a + 1 or offsets[b] - low <= CHUNK_BYTES:
            _, _, hashes, first_word = words_of(raw[low : offsets[b]], offsets[a : b + 1] - low)
            yield a, sparse_suffixes(hashes, first_word, words, prefix)
            continue
        hashes = long_hashes(raw[low : offsets[b]])
        for c in range(0, len(hashes), step):
            part = hashes[c : c + step + words - 1]
            s = sparse_suffixes(part, np.array([0, len(part)]), words, prefix)
            yield a, s | {k: s[k] + c for k in ("at", "first", "last")} | {"base": s["base"] - c}


def _suffix_rows(words: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, s in _each_chunk(batch.column(2), words, prefix):
                row = pa.array(s["text"] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), *(pa.array(s[k].astype(np.int32)) for k in ("at", "first", "last")), pa.array(s["key"]), pa.array(s["span"])],
                    names=["doc", "text_key", "at", "first", "last", "key", "span"],
                )

    return run


def _window_rows(words: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            wanted = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            of = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            asked = np.unique(of << 32 | wanted)
            for a, s in _each_chunk(batch.column(2), words, prefix):
                use = np.flatnonzero(np.isin((s["text"] + a) << 32 | s["at"], asked))
                wide = (s["last"] - s["first"] + 1)[use]
                at = np.repeat(use, wide)
                start = s["first"][at] + np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                place = start + s["base"][at]
                hashes = WORD_POWERS.slices(s["sums"], place, place + words)
                row = pa.array(s["text"][at] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32)), pa.array(s["key"][at]), pa.array(hashes.view(np.int64))],
                    names=["doc", "text_key", "at", "key", "window"],
                )

    return run


def _sorted_runs(rows: DataFrame, content: str, parting: bool) -> DataFrame:
    """The rows (key, ``content``, doc, text_key, at, ...) that matter after their sort by key, content and place.

    ``again`` marks those that are not the first of their run of equal content,
    ``head`` is that first one's place. If ``parting``, ``parted`` marks the heads
    of runs that have another run under the same key. Rows of heavy keys are
    sorted in ``hot_share`` parts of each run. The first place of every part is
    known before, from partial minima, and that of the run from those of its parts; it is
    sorted into each part ahead of its rows, so ``head`` means the same there.
    """
    place, names = F.struct("doc", "text_key", "at"), rows.columns
    heavy, share = heavy_keys(rows, "key")
    many = F.col("key").isin(heavy) if heavy else F.lit(False)
    by_key = W.partitionBy("key").orderBy(content, "doc", "text_key", "at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    in_run = W.partitionBy("key", content).orderBy("doc", "text_key", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    sorted_rows = rows.where(~many)
    sorted_rows = sorted_rows.withColumn("others", F.first(content).over(by_key) != F.last(content).over(by_key) if parting else F.lit(False))
    own = place == F.col("head")
    found = sorted_rows.withColumn("head", F.first(place).over(in_run)).select(*names, "head", (~own).alias("again"), (own & F.col("others")).alias("parted"))
    found = found.where("again or parted")
    if not heavy:
        return found
    salted = rows.where(many).withColumn("salt", F.pmod(F.xxhash64("doc", "text_key", "at"), F.lit(share)))
    parts = salted.groupBy("key", content, "salt").agg(F.min(place).alias("part_head"))
    parts = materialize(parts.withColumn("run_head", F.min("part_head").over(W.partitionBy("key", content))))  # at most ``share`` rows a run
    leads = [F.col(c) if c in ("key", content) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    ahead = parts.select(*leads, "salt", "run_head", F.lit(0).alias("turn"))
    behind = salted.select(*names, "salt", F.lit(None).cast(parts.schema["run_head"].dataType).alias("run_head"), F.lit(1).alias("turn"))
    in_part = W.partitionBy("key", content, "salt").orderBy("turn", "doc", "text_key", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    hot = materialize(ahead.unionByName(behind).withColumn("head", F.first("run_head").over(in_part)).where("turn = 1").select(*names, "head"))
    found = found.unionByName(hot.where(~own).select(*names, "head", F.lit(True).alias("again"), F.lit(False).alias("parted")))
    if not parting:
        return found
    runs = parts.groupBy("key").agg(F.min(content) != F.max(content)).toDF("parted_key", "several").where("several")  # as few keys as are heavy
    parted = hot.where(own).join(F.broadcast(runs), F.col("key") == F.col("parted_key"), "left_semi")
    return found.unionByName(parted.select(*names, "head", F.lit(False).alias("again"), F.lit(True).alias("parted")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """(doc, text_key, first, past, first_doc): word ranges whose windows of ``words`` words all occur earlier, and the first document that holds them in the same stretch.

    Order is (id, hash of the text, place), null ids first. Ranges of a document may overlap.
    """
    doc = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("body")).where(F.length("body") >= 2 * words - 1)
    head = [T.StructField("doc", doc), T.StructField("text_key", T.LongType()), T.StructField("at", T.IntegerType())]
    schema = T.StructType([*head, T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("span", T.LongType())])
    suffixes = materialize(rows.mapInArrow(_suffix_rows(words, prefix), schema))
    runs = materialize(_sorted_runs(suffixes, "span", True))
    whole = runs.where("again").select("doc", "text_key", "first", (F.col("last") + words).alias("past"), F.col("head.doc").alias("first_doc"))

    wanted = runs.where("parted").groupBy(F.col("head.doc").alias("doc_w"), F.col("head.text_key").alias("key_w")).agg(F.collect_set("head.at").alias("wanted"))
    found = rows.join(wanted, rows["doc"].eqNullSafe(wanted["doc_w"]) & (rows["text_key"] == wanted["key_w"])).select("doc", "text_key", "body", "wanted")
    schema = T.StructType([*head, T.StructField("key", T.LongType()), T.StructField("window", T.LongType())])
    windows = materialize(found.mapInArrow(_window_rows(words, prefix), schema))
    edges = _sorted_runs(windows, "window", False).select("doc", "text_key", F.col("at").alias("first"), (F.col("at") + words).alias("past"), F.col("head.doc").alias("first_doc"))
    return whole.unionByName(edges)


def _merged(first: np.ndarray, past: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), past.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these ranges of words; each takes along the white space up to the next word."""
    data = text.encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    inside = ~WORD_SPACE[raw]
    starts = np.append(np.flatnonzero(inside & ~np.r_[False, inside[:-1]]), len(raw))
    kept, at = [], 0
    for a, b in ranges:
        kept.append(data[at : starts[a]])
        at = starts[min(b, len(starts) - 1)]
    return b"".join([*kept, data[at:]]).decode("utf-8")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with every passage of at least ``words`` words removed from ``text_col`` where it occurred earlier.

    A word goes when it lies in a window of ``words`` words that occurs earlier,
    by (id, hash of the text, place), in the same document or another. Words are
    ``[^\\x20\\x09-\\x0D]+``, compared exactly. All rows stay, shortened or
    emptied; a null text stays null, and texts of fewer words stay as they are.
    Rows that repeat both id and text are one source and get the same result.
    Three columns are added (underscores appended to names already taken):
    ``removed``, the word ranges cut out, ``removed_words``, their number of
    words, and ``first_docs``, ids of earlier documents that hold the passages: for
    each stretch the first one with the same words around it. Other columns pass
    through; an empty table gives an empty one.
    """
    names = [fresh(docs, n) for n in ("removed", "removed_words", "first_docs")]
    doc, key, cuts = fresh(docs, "cut_doc"), fresh(docs, "cut_key"), fresh(docs, "cuts")
    found = repeats(docs, id_col, text_col, words, prefix).groupBy("doc", "text_key").agg(
        F.collect_set(F.struct("first", "past")).alias("ranges"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")
    )
    found = found.select(
        F.col("doc").alias(doc), F.col("text_key").alias(key), F.struct(F.col("ranges.first").alias("first"), F.col("ranges.past").alias("past"), F.col("first_docs").alias("docs")).alias(cuts)
    )

    @F.pandas_udf("text string, removed array<struct<first: int, past: int>>, words int")
    def cut(text: pd.Series, first: pd.Series, past: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, first, past, strict=True):
            ranges = _merged(a, b) if t is not None else []
            rows.append((cut_words(t, ranges) if ranges else t, [{"first": x, "past": y} for x, y in ranges], sum(y - x for x, y in ranges)))
        return pd.DataFrame(rows, columns=["text", "removed", "words"])

    joined = docs.join(found, docs[id_col].eqNullSafe(found[doc]) & (F.xxhash64(docs[text_col]) == found[key]), "left")
    has = F.col(cuts).isNotNull()
    done = fresh(docs, "cut_text")
    joined = joined.withColumn(done, cut(F.when(has, F.col(text_col)), F.col(f"{cuts}.first"), F.col(f"{cuts}.past")))
    out = [F.when(has, F.col(f"{done}.text")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(
        *out, F.coalesce(F.col(f"{done}.removed"), F.array()).alias(names[0]), F.coalesce(F.col(f"{done}.words"), F.lit(0)).alias(names[1]), F.coalesce(F.col(f"{cuts}.docs"), F.array()).alias(names[2])
    )
