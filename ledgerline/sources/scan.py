"""Readers of manifests, texts, feeds and reports, with one disposition for every candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.lexicon import READ_FAILED

MANIFEST = "id string, name string, mime_type string, folder_id string, modified_time string, path string"
REPOS = (
    "repo_ref string, name string, owner string, description string, primary_language string, languages array<string>, is_fork boolean, is_private boolean, stars int, forks int, "
    "commit_count int, pushed_at string, readme string, commits array<struct<sha: string, message: string, authored_at: string>>"
)
POSTINGS = "source string, external_id string, title string, company string, location string, remote boolean, posted_at string, url string, description string"
MESSAGES = "message_id string, subject string, sender string, received_at string, body string"
CONTACTS = "company string, name string, title string, email string, source string"
UPLOAD_TYPES = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "csv": "text/csv"}


def instant(text: Column) -> Column:
    """ISO 8601 with ``Z`` or an offset; anything else is null."""
    return F.try_to_timestamp(text)


def documents(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """The manifest's rows with the whole text of each path; text is null where there is none.

    A path is taken below ``folder``, or, if no file is there and it begins with the folder's own name, below the folder's parent.
    """
    listed = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath()
    # the path of the file without scheme and store; a plus sign stands for itself there
    file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.substring(file, F.lit(len(root) + 2), F.length(file)).alias("file"), F.col("value").alias("text"))
    below, own = F.regexp_replace("path", "^(\\./|/)+", ""), root.rpartition("/")[2] + "/"
    places = F.array(F.struct(F.lit(0).alias("turn"), below.alias("file")), F.struct(F.lit(1).alias("turn"), F.when(F.startswith(below, F.lit(own)), F.substring(below, F.lit(len(own) + 1), F.length(below))).alias("file")))
    tried = listed.select("path").distinct().select("path", F.inline(places))
    found = tried.join(texts, "file").groupBy("path").agg(F.min_by("text", "turn").alias("text"))
    return listed.join(found, "path", "left").select(*listed.columns, "text").withColumn("modified_time", instant(F.col("modified_time")))


def repositories(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(REPOS).option("multiLine", True).json(manifest).withColumn("pushed_at", instant(F.col("pushed_at")))


def commits(repos: DataFrame) -> DataFrame:
    """A row per commit: repo_ref, sha, message, authored_at, ref (repo@sha)."""
    each = repos.select("repo_ref", F.explode("commits").alias("c"))
    return each.select("repo_ref", "c.sha", "c.message", instant(F.col("c.authored_at")).alias("authored_at"), F.concat("repo_ref", F.lit("@"), "c.sha").alias("ref"))


def postings(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Postings after ``since``; with it, those without a date are left out."""
    rows = spark.read.schema(POSTINGS).option("multiLine", True).json(path).withColumn("posted_at", instant(F.col("posted_at")))
    return rows if since is None else rows.where(F.col("posted_at") > F.lit(since))


def messages(spark: SparkSession, path: str, query: str = "", since=None) -> DataFrame:
    """Messages after ``since`` that have any term of ``query`` (``a OR "b c"``) in subject or body."""
    rows = spark.read.schema(MESSAGES).option("multiLine", True).json(path).withColumn("received_at", instant(F.col("received_at")))
    terms = [t.strip().strip('"').lower() for t in query.split(" OR ") if t.strip().strip('"')]
    if terms:
        text = F.lower(F.concat_ws(" ", "subject", "body"))
        rows = rows.where(F.exists(F.lit(terms), lambda t: F.contains(text, t)))
    return rows if since is None else rows.where(F.col("received_at") > F.lit(since))


def with_contacts(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Rows with their company's contact, the first by name; null where there is none."""
    first = contacts.groupBy("company").agg(F.min(F.struct("name", "title", "email")).alias("contact"))
    return rows.join(first, "company", "left")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files directly in a folder: upload_ref, title, mime_type (null if unknown), text, modified_time."""
    files = spark.read.text(folder, wholetext=True).select("value", "_metadata.file_name", "_metadata.file_modification_time")
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    mime = F.coalesce(*[F.when(suffix == k, v) for k, v in UPLOAD_TYPES.items()])
    return files.select(F.col("file_name").alias("upload_ref"), F.regexp_replace("file_name", r"\.[^.]+$", "").alias("title"), mime.alias("mime_type"), F.col("value").alias("text"), F.col("file_modification_time").alias("modified_time"))


def drive_exclusion(mime: Column, folder: Column, allowed: list[str], own_folder: str | None, broad: bool = False) -> Column:
    """Why a document is left out, the first reason that holds: mime_not_allowed:<type>, out_of_scope; null if it isn't."""
    outside = F.lit(not broad) & (F.lit(own_folder is None) | ~folder.eqNullSafe(F.lit(own_folder)))
    return F.when(~F.coalesce(mime.isin(allowed), F.lit(False)), F.concat(F.lit("mime_not_allowed:"), F.coalesce(mime, F.lit("")))).when(outside, "out_of_scope")


def repo_exclusion(fork: Column, private: Column, owner: Column, own: str, allow_private: bool = False) -> Column:
    return F.when(fork, "fork_excluded").when(private & F.lit(not allow_private), "private_excluded").when(F.lower(owner) != own.lower(), "owner_out_of_scope")


def disposition(exclusion: Column, text: Column) -> Column:
    """policy_excluded, read_failed or ok: every candidate gets exactly one."""
    failed = text.isNull() | text.rlike(READ_FAILED)
    return F.when(exclusion.isNotNull(), "policy_excluded").when(failed, "read_failed").otherwise("ok")


def listed_lines(report: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, mime_type, id) of lines such as ``- name (type) [id]``; other lines are left out."""
    pattern = r"^\s*[-*]?\s*(.+?)\s+\(([^()]+)\)\s+\[(?:ID: )?([^\[\]]+)\]\s*$"
    lines = report.select(F.explode(F.split(text_col, "\n")).alias("line")).where(F.col("line").rlike(pattern))
    return lines.select(*(F.regexp_extract("line", pattern, i).alias(n) for i, n in enumerate(("name", "mime_type", "id"), 1)))


def changed_since(rows: DataFrame, at: Column, since) -> DataFrame:
    return rows.where(at > F.lit(since))


def by_reference(rows: DataFrame, ref_col: str, base: str) -> DataFrame:
    """Rows of a source or of spans in it."""
    return rows.where((F.col(ref_col) == base) | F.startswith(F.col(ref_col), F.lit(f"{base}#chars=")))
