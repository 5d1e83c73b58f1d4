"""The element tree of raw texts: headings, paragraphs, list items, quotes and code, with exact spans and parents."""

from __future__ import annotations

import re
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.graph import subtrees, trails
from ledgerline.operators.segments import _DATES, _ENDS, _TITLE, LINE_BREAK, MAX_CHARS, SPACE, cut_with, in_slices, stands_alone

VERSION = 1
# fixed values: how lines of each kind begin
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s")
_ITEM = re.compile(r"^(\s*)(?:[-*•·]|\d+[.)])\s+")
_QUOTE = re.compile(r"^ {0,3}>")
_FENCE = re.compile(r"^ {0,3}(```|~~~)")
_SENTENCE_END = re.compile(r"[.!?][)\"”']*\s")

ELEMENT = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("level", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("body", T.StringType()),
])
_ARROW = pa.list_(pa.struct([("seq", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("level", pa.int32()), ("parent", pa.int32()), ("body", pa.string())]))


def _capitals(line: str) -> bool:
    return stands_alone(line) and not (_ITEM.match(line) or line.lstrip().startswith("#") or ":" in line or _TITLE.match(line) or _DATES.match(line))


def _kind(line: str) -> str:
    """What a line begins: blank, heading, code, quote, item, entry (a title or date) or text."""
    if not line.strip():
        return "blank"
    if _HEADING.match(line) or _capitals(line):
        return "heading"
    if _FENCE.match(line):
        return "code"
    if _QUOTE.match(line):
        return "quote"
    if _ITEM.match(line):
        return "item"
    return "entry" if _TITLE.match(line) or _DATES.match(line) else "text"


#: The kind of line that goes on with an element of each kind; a blank line ends all but a paragraph.
GOES_ON = {"quote": "quote", "item": "text", "paragraph": "text", "code": "code"}


class Line(NamedTuple):
    """A line that carries something; ``block`` numbers the fenced block it lies in."""

    no: int
    kind: str
    gap: bool
    alone: bool
    words: int
    ends: bool
    block: int


class Run(NamedTuple):
    """An element as far as it has been read: its number and what decides whether the next line belongs to it."""

    seq: int
    kind: str
    words: int
    ends: bool
    fixed: bool
    block: int


def _read(lines: list[str]) -> list[Line]:
    """Every line but the blank ones outside of fenced blocks; from an opening fence to the closing one, or the end, all is code."""
    kinds = [_kind(x) for x in lines]
    fences = list(accumulate(k == "code" for k in kinds))
    found, before = [], -1
    for no, (text, kind, n) in enumerate(zip(lines, kinds, fences, strict=True)):
        fenced = kind == "code" or n % 2 == 1
        if kind == "blank" and not fenced:
            continue
        flat = text.split()
        found.append(Line(no, "code" if fenced else kind, no > before + 1, stands_alone(text), len(flat), text.rstrip().endswith(_ENDS), (n + 1) // 2 if fenced else 0))
        before = no
    return found


def _belongs(run: Run, line: Line) -> bool:
    if GOES_ON.get(run.kind) != line.kind or run.block != line.block:
        return False
    if not line.gap:
        return True
    # a blank line is only a scrap of layout where a word or two are parted from open text
    return run.kind == "paragraph" and not (line.alone or run.fixed or run.ends) and min(run.words, line.words) <= 2


def _after(run: Run, line: Line) -> Run:
    """The run once ``line`` has been read."""
    if not _belongs(run, line):
        kind = "paragraph" if line.kind in ("text", "entry") else line.kind
        return Run(run.seq + 1, kind, line.words, line.ends, line.alone, line.block)
    if line.alone and not line.gap:
        return run._replace(words=line.words, ends=line.ends, fixed=True)
    return run._replace(words=run.words + line.words, ends=line.ends)


def _level(kind: str, line: str) -> int | None:
    if kind == "heading":
        return len(mark.group(1)) if (mark := _HEADING.match(line)) else 1
    return 1 + len(_ITEM.match(line).group(1)) // 2 if kind == "item" else None


def elements_of(raw: str) -> list[dict[str, object]]:
    """Elements in document order.

    Lines are classified, a fold numbers the runs they form, and each run is an
    element. Its parent is the latest heading before it, for a heading the latest of a lower level.
    """
    lines = raw.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    read = _read(lines)
    runs = list(accumulate(read, _after, initial=Run(-1, "", 0, False, False, 0)))[1:]
    out, latest = [], {}
    for seq, members in groupby(zip(runs, read, strict=True), key=lambda pair: pair[0].seq):
        members = list(members)
        kind, first, last = members[0][0].kind, members[0][1].no, members[-1][1].no
        level = _level(kind, lines[first])
        above = [s for depth, s in latest.items() if kind != "heading" or depth < level]
        out.append({"seq": seq, "kind": kind, "start": starts[first], "end": starts[last + 1] - 1, "level": level, "parent": max(above, default=None), "body": "\n".join(lines[first : last + 1])})
        if kind == "heading":
            latest[level] = seq
    return out


def elements(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, seq, kind, start, end, level, parent, body) of every document; null and blank texts have none."""

    @F.arrow_udf(T.ArrayType(ELEMENT))
    def scan(text: pa.Array) -> pa.Array:
        return in_slices(lambda texts: [elements_of(t or "") for t in texts], _ARROW, text)

    return docs.select(id_col, F.explode(scan(F.col(text_col))).alias("e")).select(id_col, "e.*")


def element_chunks(found: DataFrame, id_col: str, limit: int = MAX_CHARS) -> DataFrame:
    """(id, seq, start, end, body): a chunk per element, long ones cut after sentences, else at a newline, a space, or hard; elements without a letter or digit give none."""

    rows = found.where(F.col("body").rlike("[A-Za-z0-9]"))
    long = rows.where(F.length("body") > limit).select(id_col, "seq", "start", F.explode(cut_with(limit, _SENTENCE_END, LINE_BREAK, SPACE)("body")).alias("c"))
    long = long.select(id_col, "seq", (F.col("start") + F.col("c.a")).alias("start"), (F.col("start") + F.col("c.b")).alias("end"), "c.body")
    return rows.where(F.length("body") <= limit).select(id_col, "seq", "start", "end", "body").unionByName(long)


def sections(found: DataFrame, id_col: str) -> DataFrame:
    """(id, section, path, elements): elements by their root heading; those before any heading have section null."""
    node, parent = F.struct(F.col(id_col), "seq"), F.when(F.col("parent").isNotNull(), F.struct(F.col(id_col), F.col("parent").alias("seq")))
    roots = subtrees(found.select(node.alias("n"), parent.alias("p")), "n", "p").select("node", "root")
    placed = found.withColumn("n", node).join(roots, F.col("n") == F.col("node"))
    heads = found.where("kind = 'heading'").select(node.alias("h"), F.trim(F.regexp_replace("body", "^[ #]+", "")).alias("path"))
    placed = placed.join(heads, F.col("root") == F.col("h"), "left")
    return placed.groupBy(F.col(id_col), F.when(F.col("h").isNotNull(), F.col("root.seq")).alias("section"), "path").agg(F.count(F.lit(1)).alias("elements"))


def heading_trails(found: DataFrame, id_col: str) -> DataFrame:
    """``found`` with trail: the texts of the headings above an element, outermost first and joined by `` > ``; a heading's ends with itself, without any it is null."""
    node = F.struct(F.col(id_col).alias("doc"), F.col("seq"))
    parent = F.when(F.col("parent").isNotNull(), F.struct(F.col(id_col).alias("doc"), F.col("parent").alias("seq")))
    heads = found.where("kind = 'heading'").select(node.alias("n"), parent.alias("p"), F.trim(F.regexp_replace("body", "^[ #]+", "")).alias("label"))
    above = trails(heads, "n", "p", "label").select(F.col("node").alias("n_"), F.array_join("trail", " > ").alias("trail"))
    governs = F.when(F.col("kind") == "heading", node).otherwise(parent)
    return found.withColumn("g_", governs).join(above, F.col("g_") == F.col("n_"), "left").select(*found.columns, "trail")


def commit_elements(commits: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, seq, kind, start, end, level, parent, body): a commit's message is one element, whole; null and empty ones have none."""
    body = F.col(text_col)
    none = F.lit(None).cast("int")
    return commits.where(body != "").select(id_col, F.lit(0).alias("seq"), F.lit("commit_message").alias("kind"), F.lit(0).alias("start"), F.length(body).alias("end"), none.alias("level"), none.alias("parent"), body.alias("body"))
