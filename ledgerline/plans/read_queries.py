"""Queries that read stored rows by filters, links and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import audits, reads
from ledgerline.tables import table


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence: part of it without an entity, superseded, said by people, or on no element."""
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, "user_attestation").when(k % 6 == 1, "github_commit").when(k % 6 == 2, "github_pr").when(k % 6 == 3, "github_readme").when(k % 6 == 4, "drive").otherwise("upload")
    ref = F.when(k % 4 == 0, F.concat(F.lit("me/repo@"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("me/repo#"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("file"), k.cast("string"), F.lit("#chars=0-9"))).otherwise(" ")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 > 0, F.col("o_custkey")).alias("entity"), F.when(k % 3 > 0, k % 100).alias("element"), (k % 7).alias("seq"), (F.col("o_orderstatus") != "P").alias("active"), kind.alias("source_type"), ref.alias("source_ref"),
    )


_EVIDENCE = """
evidence AS (
  SELECT k AS id, CASE WHEN k % 5 > 0 THEN o_custkey END AS entity, CASE WHEN k % 3 > 0 THEN k % 100 END AS element, k % 7 AS seq, o_orderstatus <> 'P' AS active,
    ['user_attestation', 'github_commit', 'github_pr', 'github_readme', 'drive', 'upload'][k % 6 + 1] AS source_type, ['me/repo@' || k, 'me/repo#' || k, 'file' || k, ''][k % 4 + 1] AS ref FROM (SELECT *, o_orderkey AS k FROM orders)
)
"""


def evidence_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that waits for an entity, with the place where a person can read it."""
    return reads.unassigned(_evidence(spark, sf_dir)).select("id", "source_type", reads.evidence_url(F.col("source_type"), F.col("source_ref")).alias("url"))


EVIDENCE_QUEUE = f"""
WITH {_EVIDENCE}
SELECT id, source_type, CASE WHEN ref = '' THEN NULL WHEN source_type = 'github_readme' THEN 'https://github.com/' || ref WHEN source_type = 'github_commit' AND contains(ref, '@') THEN 'https://github.com/me/repo/commit/' || id
  WHEN source_type = 'github_pr' AND contains(ref, '#') THEN 'https://github.com/me/repo/pull/' || id WHEN source_type = 'drive' THEN 'https://drive.google.com/open?id=' || ref END AS url
FROM evidence WHERE entity IS NULL AND active AND source_type <> 'user_attestation'
"""


def evidence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence in use of each entity on elements that some order of high price names, in document order."""
    named = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select((F.col("o_orderkey") % 100).alias("element"))
    found = reads.of_elements(_evidence(spark, sf_dir), named).where("entity is not null")
    return reads.minted(found, reads.document_order(), "place", group=["entity"]).select("id", "entity", "element", "place")


EVIDENCE_PLACES = f"""
WITH {_EVIDENCE}
SELECT id, entity, element, row_number() OVER (PARTITION BY entity ORDER BY element, seq, id)::INT AS place FROM evidence WHERE active AND entity IS NOT NULL AND element IN (SELECT o_orderkey % 100 FROM orders WHERE o_totalprice > 400000)
"""


def application_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as applications, their first part as the job, their lines as outreach."""
    orders, lines, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = orders.select(F.col("o_orderkey").alias("application"), (F.col("o_orderkey") % 2500).alias("job"))
    jobs = part.select(F.col("p_partkey").alias("job"), F.col("p_name").alias("title"), F.concat(F.lit("https://jobs/"), F.col("p_partkey").cast("string")).alias("url"))
    outreach = lines.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s")).select(F.col("l_orderkey").alias("application"), F.col("l_linenumber").alias("id"), F.col("s").cast("string").alias("recipient"), F.lit("sent").alias("state"))
    return reads.applications(rows, jobs, outreach)


APPLICATION_LINKS = """
WITH first AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1)
SELECT o_orderkey AS application, o_orderkey % 2500 AS job, p_name AS title, 'https://jobs/' || p_partkey AS url, s::VARCHAR AS recipient, CASE WHEN s IS NOT NULL THEN 'sent' END AS outreach_state
FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2500 LEFT JOIN first ON l_orderkey = o_orderkey
"""

def golden_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided orders with their lines as evidence, as JSON."""
    orders, lines, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending_review")
    claims = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "why").alias("note"), F.col("o_orderpriority").alias("action"), F.lit(None).cast("string").alias("problem"), F.lit("r").alias("result"))
    links = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("place"), F.col("p").alias("evidence"), F.lit("action").alias("field"), F.when(F.col("l_linenumber") == 1, "q").alias("quote"))
    evidence = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit("part").alias("source_type"), F.col("p_brand").alias("source_ref"), F.col("p_type").alias("text"))
    found = audits.golden_examples(claims, links, evidence)
    return found.withColumn("evidence", F.to_json("evidence", {"ignoreNullFields": "false"}))


GOLDEN_EXAMPLES = """
WITH links AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
listed AS (
  SELECT l_orderkey, to_json(list({'field': 'action', 'source_type': CASE WHEN p_partkey IS NOT NULL THEN 'part' END, 'source_ref': p_brand, 'text': p_type, 'quote': CASE WHEN l_linenumber = 1 THEN 'q' END} ORDER BY l_linenumber))::VARCHAR AS e
  FROM links LEFT JOIN part ON p_partkey = p AND p_size > 10 GROUP BY 1
)
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'why' END AS note, o_orderpriority AS action, NULL AS problem, 'r' AS result, coalesce(e, '[]') AS evidence
FROM orders LEFT JOIN listed ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'
"""


def traded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations by suppliers of one order's lines, and by customers and suppliers that meet in an order."""
    orders, lines, supplier, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier", "customer"))
    of = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.min("s_nationkey").alias("low"), F.max("s_nationkey").alias("high"))
    first = of.where("low < high").groupBy(F.col("high").alias("a"), F.col("low").alias("b")).agg(F.count(F.lit(1)).alias("together"))
    met = of.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey <> low and o_orderpriority = '1-URGENT'")
    second = met.groupBy(F.col("c_nationkey").alias("a"), F.col("low").alias("b")).agg(F.count(F.lit(1)).alias("urgent"))
    return audits.union_of_pairs(first, second, "together", "urgent")


TRADED_PAIRS = """
WITH o AS (SELECT l_orderkey, min(s_nationkey) AS low, max(s_nationkey) AS high FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
x AS (
  SELECT low AS a, high AS b, 1 AS t, 0 AS u FROM o WHERE low < high
  UNION ALL SELECT least(c_nationkey, low), greatest(c_nationkey, low), 0, 1 FROM o JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> low AND o_orderpriority = '1-URGENT'
)
SELECT a, b, sum(t)::BIGINT AS together, sum(u)::BIGINT AS urgent FROM x GROUP BY 1, 2
"""

QUERIES = {"evidence_queue": (evidence_queue, EVIDENCE_QUEUE), "evidence_places": (evidence_places, EVIDENCE_PLACES), "application_links": (application_links, APPLICATION_LINKS), "golden_examples": (golden_examples, GOLDEN_EXAMPLES), "traded_pairs": (traded_pairs, TRADED_PAIRS)}
