"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought into a canonical form: lower case, copyright lines and
"all rights reserved" gone, every run of ASCII punctuation and white space one
space, equivalent spellings made equal. The SHA-256 of the entire
text in this form is joined to the digests of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, skewed_lookup
from ledgerline.llm.license_texts import SPELLINGS, TEXTS, full_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that starts with a copyright sign or word and then names a year, a sign or a place for one; Java's and DuckDB's patterns agree on it.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n©]*(copyright|©|\(c\))[ \t]*(\(c\)|©|[0-9]|<|\[|\{|by )[^\n]*"
RESERVED = r"all rights reserved\.?"
APART = r"[\x00-\x2f\x3a-\x60\x7b-\x7f“”‘’–—©]+"
#: Up to so many known digests are broadcast.
BROADCAST_KNOWN = 50_000


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    out = F.translate(text, UPPER, LOWER)
    # only texts that have the words pay for their patterns
    signed = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("(c)"))
    out = F.when(signed, F.regexp_replace(out, COPYRIGHT_LINE, "$1")).otherwise(out)
    out = F.when(F.contains(out, F.lit("all rights reserved")), F.regexp_replace(out, RESERVED, " ")).otherwise(out)
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), APART, " ")
    for other, here in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(here))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) with and without each title, then entire licences."""
    return [(name, f"{title}\n{text}" if title else text) for name, titles, text in TEXTS for title in ["", *titles]] + full_texts()


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest), each digest once; of several licences with one digest the first by name."""
    known = spark.createDataFrame(texts if texts is not None else known_texts(), "license string, text string")
    return known.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with license_digest and license (underscores appended to names already taken).

    ``license`` is the known licence that the entire text is, else null.
    ``known`` has license and digest, each digest once. A null text has a null
    digest and no licence; one that is empty in canonical form never matches.
    All rows stay, repeated ones too; an empty table gives an empty one.
    """
    whole, name = fresh(docs, "license_digest"), fresh(docs, "license")
    table = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select(F.col("digest").alias(whole), F.col("license").alias(name))
    out = docs.withColumn(whole, digest(F.col(text_col).cast("string")))
    if len(table.select(F.lit(1)).limit(BROADCAST_KNOWN + 1).collect()) > BROADCAST_KNOWN:
        return skewed_lookup(out, table, whole)
    return out.join(F.broadcast(table), whole, "left").select(*(F.col(f"`{c}`") for c in out.columns), name)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, {_quoted(COPYRIGHT_LINE)}, {_quoted(chr(92) + '1')}, 'g')"
    out = f"regexp_replace({out}, {_quoted(RESERVED)}, ' ', 'g')"
    out = f"regexp_replace(' ' || {out} || ' ', {_quoted(APART)}, ' ', 'g')"
    for other, here in SPELLINGS:
        out = f"replace({out}, {_quoted(other)}, {_quoted(here)})"
    return f"trim({out}, ' ')"


#: The same in DuckDB.
ORACLE_SQL = f"""
WITH texts(license, text) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in known_texts())}),
known AS (SELECT sha256({_canonical_sql("text")}) AS license_digest, min(license) AS license FROM texts GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS license_digest FROM documents)
SELECT doc_id, docs.license_digest, license FROM docs LEFT JOIN known ON docs.license_digest = known.license_digest AND docs.license_digest <> sha256('')
"""
