"""Segments of texts with exact spans: reflowed lines, paragraphs, chunks, and checks of coverage."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.order import batches

MAX_CHARS = 1200
VERSION = 1

# fixed values: shapes of lines that stand alone
_BULLET = re.compile(r"^\s*(?:[-*•·]|\d+[.)])\s+")
_LABEL = re.compile(r"^\s*[A-Za-z][\w ]{0,24}:\s+\S")
_HEADER = re.compile(r"^\s*#")
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\.? \d{4}"
_DATES = re.compile(rf"^\s*{_MONTH}(?:\s*(?:[-‐-―]|to)\s*(?:{_MONTH}|Present))?\s*$")
_TITLE = re.compile(r"^\s*\S.{0,58}?, [A-Z]{2,8}\s*$")
_BROKEN_WORD = re.compile(r"(\w)-[ \t]*\n[ \t]*(?=[a-z])")
_ENDS = (".", "!", "?", ":", ";")
BLANKS = " \t\n\x0b\f\r"
#: So many bytes of texts, and rows, are turned into Python objects at a time.
SLICE_CHARS, SLICE_ROWS = 1_000_000, 1000
#: Where long texts may be cut, and what is left out after a cut.
LINE_BREAK, SPACE, _NEXT = re.compile("\n"), re.compile(" "), re.compile("[\n ]*")


def in_slices(run: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``run`` over rows of the columns (lists of values, the texts first) in slices of about ``SLICE_CHARS`` bytes of text, as one array: Python holds the objects of one slice, however many rows a batch has."""
    ends = list(accumulate(n or 0 for n in pc.binary_length(columns[0]).to_pylist()))
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, bisect_right(ends, (ends[at - 1] if at else 0) + SLICE_CHARS))
        to = min(to, at + SLICE_ROWS)
        out.append(pa.array(run(*(c.slice(at, to - at).to_pylist() for c in columns)), kind))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], kind)


def stands_alone(line: str) -> bool:
    """Whether a line begins structure: a bullet, header, label, heading in capitals, entry title or date."""
    if any(p.match(line) for p in (_BULLET, _HEADER, _LABEL, _TITLE, _DATES)):
        return True
    flat = " ".join(line.split())
    letters = [c for c in flat if c.isalpha()]
    return 0 < len(flat) <= 48 and ":" not in flat and len(letters) >= 4 and all(map(str.isupper, letters)) and len(flat.split()) <= 6


class Read(NamedTuple):
    """A line that isn't blank: its words, whether it begins structure, and whether blank lines stand before it."""

    words: list[str]
    alone: bool
    parted: bool


class Flow(NamedTuple):
    """The run that a line has been put in: its number, its words so far, whether it is open to scraps, and whether its end is that of a sentence."""

    run: int
    size: int
    open: bool
    ended: bool


def _lines_read(text: str) -> list[Read]:
    whole = _BROKEN_WORD.sub(r"\1", re.sub("\r\n?", "\n", text))
    split = [(line, line.split()) for line in whole.split("\n")]
    filled = [k for k, (_, words) in enumerate(split) if words]
    return [Read(split[k][1], stands_alone(split[k][0]), k > before + 1) for before, k in zip([-1, *filled], filled, strict=False)]


def _flows(flow: Flow, line: Read) -> Flow:
    """Where a line goes. It goes on with the run before it unless it begins structure; across blank lines it does so
    only if one of the two is a scrap of at most two words and the run is open text without an end."""
    scrap = flow.open and not flow.ended and min(flow.size, len(line.words)) <= 2
    ended = line.words[-1].endswith(_ENDS)
    if flow.run < 0 or line.alone or (line.parted and not scrap):
        return Flow(flow.run + 1, len(line.words), not line.alone, ended)
    return flow._replace(size=flow.size + len(line.words), ended=ended)


def reflow(text: str) -> str:
    """Lines that were wrapped joined again; structure and real paragraph breaks kept.

    Lines are read into words, a fold numbers the runs they form, and every run is one line of the result, after an
    empty one where blank lines stood before it. Blank lines at the ends go.
    """
    read = _lines_read(text)
    runs = list(accumulate(read, _flows, initial=Flow(-1, 0, False, False)))[1:]
    out = []
    for number, members in groupby(zip(runs, read, strict=True), key=lambda pair: pair[0].run):
        lines = [line for _, line in members]
        out += [""] * (lines[0].parted and number > 0) + [" ".join(w for line in lines for w in line.words)]
    return "\n".join(out)


def reflowed(docs: DataFrame, text_col: str = "text", name: str = "normal_text") -> DataFrame:
    """``docs`` with the reflowed text; null stays null. Lines depend on those before, so this is an Arrow function."""

    @F.arrow_udf(T.StringType())
    def run(text: pa.Array) -> pa.Array:
        return in_slices(lambda texts: [None if t is None else reflow(t) for t in texts], pa.string(), text)

    return docs.withColumn(name, run(F.col(text_col)))


def paragraphs(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, paragraph, start, end, body): blocks between blank lines with spans in code points, end exclusive."""
    blocks = docs.select(id_col, F.posexplode(F.split(text_col, "\n\n")).alias("block", "raw"))
    before = W.partitionBy(id_col).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum(F.length("raw") + 2).over(before), F.lit(0)))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", "^\n+", ""))
    body = F.regexp_replace(F.regexp_replace("raw", "^\n+", ""), "\n+$", "")
    cut = blocks.select(id_col, F.col("block").alias("paragraph"), (F.col("offset") + lead).alias("start"), body.alias("body")).where("body <> ''")
    return cut.select(id_col, "paragraph", "start", (F.col("start") + F.length("body")).alias("end"), "body")


def spans_within(text: str, limit: int, *marks: re.Pattern[str]) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that cover a text but for white space between them.

    A span ends at the last place inside the limit where the first pattern
    matches (in front of the match's last character), else the second, and so on, else at the limit.
    """
    places = [[(m.end() - 1, m.start()) for m in mark.finditer(text)] for mark in marks] if len(text) > limit else []
    spans, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > limit:
            last = (held[i - 1] for held in places if (i := bisect_left(held, (at + limit,))))
            end = next((place for place, begun in last if begun >= at and place > at), at + limit)
        spans.append((at, end))
        at = _NEXT.match(text, end).end()
    return spans


SPANS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("body", T.StringType())]))
ARROW_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("body", pa.string())]))


def cut_with(limit: int, *marks: re.Pattern[str]):
    """An Arrow function from texts to their spans within ``limit``, each with its slice of the text."""

    @F.arrow_udf(SPANS)
    def cut(text: pa.Array) -> pa.Array:
        return in_slices(lambda texts: [[{"a": a, "b": b, "body": t[a:b]} for a, b in spans_within(t, limit, *marks)] for t in texts], ARROW_SPANS, text)

    return cut


def chunked(docs: DataFrame, id_col: str, text_col: str = "text", limit: int = MAX_CHARS) -> DataFrame:
    """(id, start, end, body): paragraphs, those beyond ``limit`` cut at the last newline, else the last space, else hard.

    Short paragraphs never leave the JVM; each cut depends on the one before, so long ones go through an Arrow function.
    """

    whole = paragraphs(docs, id_col, text_col)
    long = whole.where(F.length("body") > limit).select(id_col, "start", F.explode(cut_with(limit, LINE_BREAK, SPACE)("body")).alias("c"))
    long = long.select(id_col, (F.col("start") + F.col("c.a")).alias("start"), (F.col("start") + F.col("c.b")).alias("end"), "c.body")
    return whole.where(F.length("body") <= limit).select(id_col, "start", "end", "body").unionByName(long)


def coverage_violations(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, start, reason) for spans out of bounds, overlapping or not equal to their slice, and for gaps that aren't white space.

    The spans of a document meet its text once, as a list, so the work grows with
    the text and not with text times spans. A null text counts as empty.
    """
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("reason", T.StringType())]))

    def of_slice(texts: list[str | None], held: list[list[dict] | None]) -> list[list[dict]]:
        rows = []
        for whole, listed in zip(texts, held, strict=True):
            whole, reached, out = whole or "", 0, []
            for s in listed or []:
                a, b = s["start"], s["end"]
                checks = {
                    "out_of_bounds": a < 0 or b > len(whole) or a >= b, "overlap": a < reached,
                    "not_the_slice": whole[max(a, 0) : b] != s["body"], "gap": bool(whole[reached:max(a, 0)].strip(BLANKS)),
                }
                out += [{"start": a, "reason": reason} for reason, broken in checks.items() if broken][:1]
                reached = max(reached, b)
            if whole[reached:].strip(BLANKS):
                out.append({"start": reached, "reason": "gap"})
            rows.append(out)
        return rows

    @F.arrow_udf(found)
    def faults(text: pa.Array, held: pa.Array) -> pa.Array:
        return in_slices(of_slice, pa.list_(pa.struct([("start", pa.int32()), ("reason", pa.string())])), text, held)

    lists = spans.groupBy(F.col(id_col).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "body"))).alias("held"))
    rows = docs.select(id_col, F.col(text_col).alias("whole")).join(lists, F.col(id_col) == F.col("k"), "left")
    return rows.select(id_col, F.explode(faults("whole", "held")).alias("fault")).select(id_col, "fault.start", "fault.reason")


def packed_batches(chunks: DataFrame, group_col: str, order_col: str, chars_col: str, most_chunks: int = 30, most_chars: int = 14_000) -> DataFrame:
    """(group, order, batch): greedy batches in order, within both budgets; a chunk beyond the second is a batch alone."""
    return batches(chunks, group_col, order_col, chars_col, most_chunks, most_chars)
