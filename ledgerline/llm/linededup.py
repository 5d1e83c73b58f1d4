"""Near-duplicate line removal by a deletion-neighbourhood join, in DataFrame functions only.

Two lines within one edit (insert, delete or replace a character) have a
deletion variant in common: each line emits itself and itself without its i-th
character, as hashed keys, and equal keys meet. To keep that affordable for
long lines the edit is placed first: with one edit, all but one half of the shorter line's
characters stay whole (long lines have more parts than two), so a line emits
variants of one part only, and only when another distinct line of nearly the
same length shares all the rest. Pairs that meet are verified with the
edit distance of their full texts, and a line goes when an earlier one is
within the bound. Equal lines meet by hash before all this. Lines of any length
take part, and the work grows with the lines of a document, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, materialize, shuffled, split_join

MAX_EDITS = 1
#: Lines of over WHOLE characters have a part for every PART characters, MOST_PARTS at most; shorter ones have two.
WHOLE, PART, MOST_PARTS = 1000, 500, 512


def _parts(size: Column) -> Column:
    return F.when(size <= WHOLE, 2).otherwise(F.least(F.lit(MOST_PARTS), F.ceil(size / PART))).cast("int")


def _edge(i: Column, size: Column) -> Column:
    """Where the i-th part of ``size`` characters begins."""
    return F.floor(i * size / _parts(size)).cast("int")


def _outside(line: Column, i: Column, size: Column) -> Column:
    """A key of all but the i-th part of a line, for pairs whose shorter line has ``size`` characters."""
    return F.xxhash64(i, size, F.substring(line, F.lit(1), _edge(i, size)), F.right(line, size - _edge(i + 1, size)))


def _rest_keys(line: Column, n: Column) -> Column:
    """Keys of what lies outside each part, for pairs whose shorter line has n characters, then for those where it has n - 1."""

    def of(size: Column) -> Column:
        two = F.array(_outside(line, F.lit(0), size), _outside(line, F.lit(1), size))
        return F.when(size <= WHOLE, two).otherwise(F.transform(F.sequence(F.lit(0), _parts(size) - 1), lambda i: _outside(line, i, size)))

    return F.concat(of(n), of(n - 1))


def _lines(rows: DataFrame) -> DataFrame:
    """A row per line that is not blank, with two independent hashes and the keys of its halves."""
    each = rows.select("doc", "text_key", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    each = each.select("*", F.length("line").alias("size"))
    return each.select(
        "doc", "text_key", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        _rest_keys(F.col("line"), F.col("size")).alias("half_keys"),
    )


def _within_one(a: Column, b: Column) -> Column:
    """Whether at most one edit parts two lines. Spark's distance takes the square of a length, so long lines are compared beyond their common start."""
    least = F.least(F.length(a), F.length(b))
    steps = F.lit([1 << k for k in range(29, -1, -1)])
    grown = lambda at, step: F.when((at + step <= least) & (F.left(a, at + step) == F.left(b, at + step)), at + step).otherwise(at)
    same = F.aggregate(F.filter(steps, lambda s: s <= least), F.lit(0), grown)
    tail = lambda line, longest: F.substring(line, same + 1 + longest.cast("int"), F.length(line))
    linear = (F.abs(F.length(a) - F.length(b)) <= 1) & (tail(a, F.length(a) >= F.length(b)) == tail(b, F.length(b) >= F.length(a)))
    return F.when(least <= WHOLE, F.levenshtein(a, b, MAX_EDITS) >= 0).otherwise(linear)


def _near_drops(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, text_key, line_no) of first occurrences that are within one edit of an earlier, different line."""
    keyed = firsts.select("at", F.posexplode("half_keys").alias("kind", "half_key"))
    shared = materialize(keyed.groupBy("half_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = split_join(keyed, shared, ["half_key"], "n")
    wanted = wanted.groupBy("at.doc", "at.text_key").agg(F.collect_list(F.struct("at.line_no", "kind", "half_key")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc": "doc_w", "text_key": "key_w"})
    found = rows.join(wanted, rows["doc"].eqNullSafe(wanted["doc_w"]) & (rows["text_key"] == wanted["key_w"]))
    # the lines are split once per document and looked up before they are told apart
    found = found.withColumn("all_lines", F.split("body", "\n")).where("size(all_lines) > 0")
    picked = F.transform("wanted", lambda w: F.struct(w["line_no"].alias("line_no"), w["kind"].alias("kind"), w["half_key"].alias("half_key"), F.get("all_lines", w["line_no"]).alias("line")))
    found = materialize(found.select("doc", "text_key", F.inline(picked)).select(F.struct("doc", "text_key", "line_no").alias("at"), "kind", "half_key", "line"))
    # a number per line, in the order of lines: least and greatest of numbers need no sorting
    found = found.repartitionByRange("at").groupBy("at").agg(F.first("line").alias("line"), F.collect_set(F.struct("kind", "half_key")).alias("keys"))
    found = materialize(found.sortWithinPartitions("at").select(F.monotonically_increasing_id().alias("n"), "at", "line", "keys"))

    size = F.length("line")
    longer = F.col("kind") >= _parts(size)  # it meets lines that have one character less
    least = F.when(longer, size - 1).otherwise(size)
    part = F.when(longer, F.col("kind") - _parts(size)).otherwise(F.col("kind"))
    before = _edge(part, least)
    rest = F.substring("line", before + 1, size - before - (least - _edge(part + 1, least)))
    parts = found.select("n", "line", F.inline("keys")).select("n", "half_key", longer.alias("longer"), rest.alias("rest"))
    variant = parts.select("n", "half_key", "longer", "rest", F.explode(F.sequence(F.lit(0), F.length("rest"))).alias("gone")).where("gone > 0 or not longer")
    variant = variant.select(
        "n", "longer",
        # a character less than the shorter line: the same place must be gone in both; else the shorter line itself
        F.xxhash64(
            "half_key",
            F.when(F.col("longer") | (F.col("gone") == 0), F.lit(0)).otherwise(F.col("gone")),
            F.when(F.col("gone") == 0, F.col("rest")).otherwise(F.concat(F.expr("left(rest, gone - 1)"), F.expr("substring(rest, gone + 1)"))),
        ).alias("v"),
    )
    groups = variant.groupBy("v").agg(
        F.min("n").alias("first"), F.max("n").alias("last"),
        F.min(F.when(~F.col("longer"), F.col("n"))).alias("short"), F.min(F.when(F.col("longer"), F.col("n"))).alias("long"),
    ).where("first <> last")
    # a row for each character of half a line, and the lines themselves
    pairs = variant.join(shuffled(groups), "v").select(
        "n", F.when(F.col("longer"), F.col("short")).when(F.col("long").isNotNull(), F.col("long")).otherwise(F.col("first")).alias("earlier")
    )
    pairs = pairs.where("earlier < n").distinct()
    pairs = pairs.join(shuffled(found.select("n", "at", "line")), "n").join(shuffled(found.select(F.col("n").alias("earlier"), F.col("line").alias("earlier_line"))), "earlier")
    return pairs.where(_within_one(F.col("line"), F.col("earlier_line"))).select("at.doc", "at.text_key", "at.line_no").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True) -> DataFrame:
    """``docs`` with every line dropped from ``text_col`` that equals, or is within one edit of, an earlier line.

    Lines are parted by ``\\n`` and ordered by (id, hash of the whole text, line
    number), null ids first. Blank lines stay. Whether the earlier line itself goes plays no part. Two columns
    are added (with underscores appended should ``docs`` have such names):
    ``lines_total`` and ``lines_dropped``, both counts over all lines. All rows
    stay, those emptied too; a null text stays null with 0 lines. Rows that
    repeat both id and text are one source, and all get the same result. An
    empty table gives an empty table; other columns pass through unchanged.
    """
    total, dropped = fresh(docs, "lines_total"), fresh(docs, "lines_dropped")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("body")).where("body is not null")
    lines = materialize(_lines(rows))
    place = F.struct("doc", "text_key", "line_no")
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.max(place).alias("last"), F.count(F.lit(1)).alias("held"), F.first("half_keys").alias("half_keys"))
    firsts = materialize(firsts)
    again = firsts.where("at <> last").select("h1", "h2", "at", "held")
    drops = split_join(lines.select("doc", "text_key", "line_no", "h1", "h2"), again, ["h1", "h2"], "held").where(place != F.col("at")).select("doc", "text_key", "line_no")
    if near:
        drops = drops.unionByName(_near_drops(rows, firsts))
    drops = drops.groupBy("doc", "text_key").agg(F.collect_set("line_no").alias("gone"))
    gone, doc, key = fresh(docs, "gone_lines"), fresh(docs, "gone_doc"), fresh(docs, "gone_key")
    drops = drops.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("gone").alias(gone))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops[doc]) & (F.xxhash64(docs[text_col]) == drops[key]), "left")
    # a column of its own: inside the lambda the text would be split anew for every line
    parts = fresh(docs, "line_parts")
    joined = joined.withColumn(parts, F.split(F.col(text_col), "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(
        *out, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).alias(total), F.coalesce(F.size(F.col(gone)), F.lit(0)).alias(dropped)
    )


#: The same rule in DuckDB: pairs are found by lengths and equal halves, and one edit is tested by leaving out characters.
ORACLE_SQL = """
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, line, length(line) AS size FROM raw WHERE trim(line, ' ') <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM lines),
firsts AS (SELECT doc_id, line_no, line, size FROM ranked WHERE nth = 1),
halves AS (
  SELECT doc_id, line_no, line, size, c.size_class, c.part FROM firsts,
  LATERAL (SELECT unnest([size, size, size - 1, size - 1]) AS size_class, unnest(['p' || left(line, size // 2), 's' || right(line, size - size // 2), 'p' || left(line, (size - 1) // 2), 's' || right(line, size - 1 - (size - 1) // 2)]) AS part) c
),
pairs AS (
  SELECT DISTINCT b.doc_id, b.line_no, b.line AS y, a.line AS x
  FROM halves a JOIN halves b ON a.size_class = b.size_class AND a.part = b.part AND a.line <> b.line AND (a.doc_id, a.line_no) < (b.doc_id, b.line_no)
),
near AS (
  SELECT DISTINCT doc_id, line_no FROM pairs
  WHERE (length(x) = length(y) AND len(list_filter(range(length(x)), lambda i: left(x, i) = left(y, i) AND substr(x, i + 2) = substr(y, i + 2))) > 0)
     OR (length(x) = length(y) + 1 AND len(list_filter(range(length(x)), lambda i: left(x, i) || substr(x, i + 2) = y)) > 0)
     OR (length(y) = length(x) + 1 AND len(list_filter(range(length(y)), lambda i: left(y, i) || substr(y, i + 2) = x)) > 0)
),
drops AS (SELECT doc_id, line_no FROM ranked WHERE nth > 1 UNION SELECT doc_id, line_no FROM near),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.line_no) FILTER (WHERE d.doc_id IS NULL) AS text, count(*) AS lines_total, count(d.doc_id) AS lines_dropped
  FROM raw r LEFT JOIN drops d ON r.doc_id = d.doc_id AND r.line_no = d.line_no GROUP BY r.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.lines_total, 0) AS INTEGER) AS lines_total, CAST(coalesce(k.lines_dropped, 0) AS INTEGER) AS lines_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
