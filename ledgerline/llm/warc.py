"""WARC archives: a writer with revisit records and a reader that splits compressed files.

The writer puts every record into a gzip member of its own. Of records with equal payloads the
one with the smallest id is stored whole, the others are revisits that refer to it; only stored
payloads leave the JVM. Each task writes files named after its attempt, and the table of files names
those of the attempts that succeeded, so a task may run again anywhere.

The reader deals byte ranges of the files to tasks. A task looks for the gzip magic from the
first byte of its range on, takes a place for the start of a record if the bytes there decode to a
record's header, reads the member to its end, wherever that is, and goes on behind it: it owns the
records that start inside its range. A range may begin inside a member that holds a stored archive,
so ``without_nested`` drops records that start before the end of a record of an earlier range.

Files are opened by ``pyarrow.fs``: local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import base64
import hashlib
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, materialize, shared_folder, split_join

# fixed values: what starts a gzip member with deflated data, and what starts a record
MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose fetch time is not known.
DATE = "2000-01-01T00:00:00Z"
#: A file is closed once it has so many bytes; a task reads ranges of RANGE_BYTES in blocks of BLOCK_BYTES; rows are sent on after OUT_BYTES.
FILE_BYTES, RANGE_BYTES, BLOCK_BYTES, OUT_BYTES = 1 << 30, 8 << 20, 1 << 18, 8 << 20

FILES = "path string, bytes long, records long"
RECORDS = (
    "path string, range_start long, offset long, bytes long, part int, record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_bytes long, payload_digest string, digest_ok boolean, payload binary, error string"
)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


# --- writing ---------------------------------------------------------------------


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member; fields without a value are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))] if value is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END) + packer.flush()


def one_line(uri: str | None) -> str | None:
    """A URI as a header can hold it: everything but printable ASCII is percent-encoded."""
    return None if uri is None else urllib.parse.quote(uri, safe="".join(map(chr, range(0x21, 0x7F))))


def page_record(record_id: str, uri: str | None, payload: bytes | None, size: int, sha1: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit of the record ``refers_to`` whose HTTP header still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", one_line(uri)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("WARC-Refers-To", refers_to and f"<{refers_to}>"), ("WARC-Profile", PROFILE if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, http if refers_to else http + (payload or b""))


def _write_rows(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        attempt, files, out = TaskContext.get().taskAttemptId(), [], None
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    path = f"{base}/records-{attempt}-{len(files)}.warc.gz"
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    about = b"software: ledgerline\r\nformat: WARC File Format 1.1\r\n"
                    head = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{attempt}-{len(files)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)
                    out.write(head)
                    files.append([f"{folder}/{path.rpartition('/')[2]}", len(head), 1])
                data = page_record(*(x.as_py() for x in row), date)
                out.write(data)
                files[-1][1] += len(data)
                files[-1][2] += 1
                if files[-1][1] >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return run


def with_revisits(rows: DataFrame, id_col: str, payload: Column, least_bytes: int = 0) -> DataFrame:
    """``rows`` with payload (binary, null for revisits), payload_bytes, sha1 (hex) and refers_to: the smallest id of the rows with an equal payload.

    Payloads are equal if their SHA-256 and sizes are. Rows that have that id themselves are stored, as
    are payloads under ``least_bytes`` and groups in which every id is null. A group may hold a third
    of all rows: it is counted before it is shuffled, and its one entry is broadcast.
    """
    key, group, first, count = (fresh(rows, n, "payload", "payload_bytes", "sha1", "refers_to") for n in ("payload_key", "payload_group", "first_id", "group_rows"))
    named = rows.withColumn("payload", F.coalesce(payload.cast("binary"), F.lit(b"")))
    named = named.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).withColumn(key, F.unhex(F.sha2("payload", 256)))
    groups = materialize(named.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col(key).alias(group)).agg(F.min(F.col(f"`{id_col}`")).alias(first), F.count(F.lit(1)).alias(count)).where(F.col(count) > 1))
    joined = split_join(named.withColumn(group, F.col(key)).drop(key), groups, [group], count, how="left")
    stored = F.col(first).isNull() | F.col(first).eqNullSafe(F.col(f"`{id_col}`"))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return joined.select(*own, F.when(stored, F.col("payload")).alias("payload"), "payload_bytes", "sha1", F.when(~stored, F.col(first)).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, record_id: Column, uri: Column, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row of ``with_revisits`` below ``folder``, which executors share; the table of files (path, bytes, records).

    ``record_id`` turns ids into URIs, for ids and refers_to alike. A null uri has no header.
    """
    columns = rows.select(record_id.alias("id"), uri.cast("string").alias("uri"), "payload", "payload_bytes", "sha1", "refers_to")
    return materialize(columns.mapInArrow(_write_rows(folder, date, file_bytes), FILES))


# --- reading ---------------------------------------------------------------------


@dataclass
class Member:
    """A gzip member: what it decodes to, its size in the file, and what is wrong with it."""

    data: bytes
    size: int
    error: str | None = None


class Blocks:
    """A file read in blocks, of which the last two are kept."""

    def __init__(self, file: BinaryIO, size: int, block: int):
        self.file, self.size, self.block, self.kept = file, size, block, {}

    def at(self, k: int) -> bytes:
        if k not in self.kept:
            if len(self.kept) > 1:
                self.kept.pop(next(iter(self.kept)))
            self.file.seek(k * self.block)
            self.kept[k] = self.file.read(min(self.block, max(0, self.size - k * self.block)))
        return self.kept[k]

    def blocks(self, start: int) -> Iterator[bytes]:
        k, skip = divmod(start, self.block)
        while k * self.block < self.size:
            yield self.at(k)[skip:]
            k, skip = k + 1, 0

    def find(self, start: int, past: int) -> int | None:
        """The first place from ``start`` up to before ``past`` at which the magic starts."""
        before, where = b"", start
        for data in self.blocks(start):
            found = (before + data).find(MAGIC)
            if found >= 0:
                place = where - len(before) + found
                return place if place < past else None
            where += len(data)
            before = (before + data)[-2:]
            if where - len(before) >= past:
                return None
        return None

    def member(self, start: int) -> Member | None:
        """The member that starts at ``start``; None if the bytes there don't decode to the head of a record."""
        unpacker, parts, fed, head = zlib.decompressobj(31), [], 0, b""
        for data in self.blocks(start):
            try:
                out = unpacker.decompress(data)
            except zlib.error as error:
                return Member(b"".join(parts), fed, f"damaged: {error}") if head.startswith(VERSION) else None
            parts.append(out)
            fed += len(data)
            if len(head) < len(VERSION):
                head = (head + out)[: len(VERSION)]
                if not VERSION.startswith(head[: len(VERSION)]):
                    return None
            if unpacker.eof:
                return Member(b"".join(parts), fed - len(unpacker.unused_data)) if head.startswith(VERSION) else None
        return Member(b"".join(parts), fed, "truncated") if head.startswith(VERSION) else None


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, _, value = line.partition(b":")
            name = key.strip().lower().decode("utf-8", "replace")
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def parse_records(data: bytes) -> Iterator[tuple]:
    """(record_type, record_id, target_uri, date, refers_to, payload_bytes, payload_digest, digest_ok, payload, error) of the records in a member."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if not data.startswith(VERSION, at) or stop < 0:
            yield (None,) * 9 + ("no record header",)
            return
        fields = _fields(data[at:stop])
        size = _number(fields.get("content-length"))
        if size is None or stop + 4 + size > len(data):
            yield (None,) * 9 + ("no content length" if size is None else "short block",)
            return
        block, kind = data[stop + 4 : stop + 4 + size], fields.get("warc-type")
        payload, full = block, len(block)
        if fields.get("content-type", "").lower().startswith("application/http"):
            head, gap, payload = block.partition(END)
            full = _number(_fields(head).get("content-length")) if kind == "revisit" else len(payload)
        digest = (fields.get("warc-payload-digest") or "").rpartition(":")[2].upper() or None
        own = None if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        bare = lambda name: (fields.get(name) or "").strip("<>") or None
        yield kind, bare("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), bare("warc-refers-to"), full, own or digest, None if own is None or digest is None else own == digest, None if kind == "revisit" else payload, None
        at = stop + 4 + size + len(END)


def records_in(file: BinaryIO, size: int, first: int, past: int, block: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(offset, bytes, part, *record) of the records that start from ``first`` up to before ``past``."""
    window, at = Blocks(file, size, block), first
    while at < past and (place := window.find(at, past)) is not None:
        found = window.member(place)
        if found is None:
            at = place + 1
            continue
        if found.error:
            yield place, found.size, 0, *(None,) * 9, found.error
            at = place + 1
            continue
        for part, fields in enumerate(parse_records(found.data)):
            yield place, found.size, part, *fields
        at = place + found.size


def _read_rows(payload: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for path, size, first, past in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = _opened(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for offset, length, part, *fields in records_in(file, size, first, past, block):
                        if not payload:
                            fields[8] = None
                        rows.append((path, first, offset, length, part, *fields))
                        held += 200 + len(fields[8] or b"")
                        if held >= OUT_BYTES:
                            yield sent(rows)
                            rows, held = [], 0
                if rows:
                    yield sent(rows)

    return run


def read_archives(files: DataFrame, payload: bool = True, range_bytes: int = RANGE_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """The records of ``files`` (path, bytes), in the columns of RECORDS; ``payload`` false leaves the payloads out.

    payload_bytes and payload_digest of a revisit are those of the full payload, from its headers; those
    of other records are computed from the payload read. A member that begins with a record's header but is
    damaged or cut off gives a row with ``error``; bytes between members are passed over. An empty
    table of files, and files without bytes, give no rows.
    """
    some = files.where(F.col("bytes") > 0)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = some.select("path", "bytes", F.explode(starts).alias("first")).withColumn("past", F.least(F.col("first") + range_bytes, F.col("bytes")))
    tasks = some.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(min(int(tasks), 100_000), "path", "first").mapInArrow(_read_rows(payload, block), RECORDS)


def without_nested(records: DataFrame) -> DataFrame:
    """``records`` (a table) without those inside a record that starts in an earlier range of their file."""
    reach = records.groupBy("path", "range_start").agg(F.max(F.col("offset") + F.col("bytes")).alias("reach"))
    before = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of a file
    ends = reach.select("path", "range_start", F.coalesce(F.max("reach").over(before), F.lit(0).cast("long")).alias("covered"))
    return records.join(ends, ["path", "range_start"]).where(F.col("offset") >= F.col("covered")).select(*records.columns)


PAGE = "urn:page:"


def archive_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes a record per page and reads the archives back: (id, payload_bytes, payload_digest, record_type, refers_to).

    A null html counts as empty, a null url has no target header, a null id stays null and never comes first;
    repeated rows are records of their own; an empty table gives no rows; other columns are left out.
    """
    kind = pages.schema[id_col].dataType
    name = lambda c: F.concat(F.lit(PAGE), F.coalesce(c.cast("string"), F.lit("")))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.col(f"`{html_col}`").cast("string"), "utf-8").alias("html"))
    rows = with_revisits(rows, "id", F.col("html"), least_bytes).drop("html")
    rows = rows.withColumn("refers_to", F.when(F.col("refers_to").isNotNull(), name(F.col("refers_to"))))
    folder = f"{shared_folder(spark)}/ledgerline/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    files = write_archives(rows, folder, name(F.col("id")), F.col("url"), file_bytes=file_bytes)
    found = without_nested(materialize(read_archives(files, payload=False, range_bytes=range_bytes).drop("payload")))
    id_of = lambda c: F.expr(f"cast(nullif(substring({c}, {len(PAGE) + 1}), '') AS {kind.simpleString()})")
    facts = found.where("error is null and record_type in ('response', 'revisit')")
    return facts.select(id_of("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH paged AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
known AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM paged)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INT >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM known
"""
