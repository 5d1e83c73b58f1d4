"""Queries over nested snapshots, digests, trails and recorded results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators import ledger, memo, segments, snapshots, structure
from ledgerline.tables import shared_folder, table


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as stories of their nations, their orders as components."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    section = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "professional_experience").when(F.col("c_mktsegment") == "FURNITURE", "other").otherwise("projects_hackathons")
    stories = customer.select(F.col("c_nationkey").alias("owner"), section.alias("section"), (F.col("c_custkey") % 3).alias("sort_order"), F.col("c_custkey").alias("entity"), F.col("c_custkey").alias("story"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("subtitle"), F.lit("").alias("dates"))
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    k = F.col("o_orderkey")
    kind = F.when((k == F.col("first")) & (k % 5 > 0), "problem").when(k % 3 == 0, "action").otherwise("result")
    rows = orders.join(first, "o_custkey").withColumn("kind", kind)
    components = rows.select(
        F.col("o_custkey").alias("story"), "kind", (k % 4).alias("place"), k.cast("string").alias("component_id"), F.concat(F.lit(" Order "), k.cast("string"), F.when(k % 2 == 0, ".").otherwise("")).alias("text"), F.array(k).alias("claim_ids"),
        F.when(F.col("kind") == "result", F.col("o_orderpriority")).alias("outcome_quote"), F.when(k % 7 > 0, F.concat(F.lit("seen "), F.col("o_orderstatus"))).otherwise("").alias("evidence_text"), (F.col("o_orderstatus") == "P").alias("attested"),
    )
    return stories, components


_SHOWN = """
stories AS (
  SELECT c_nationkey AS owner, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'professional_experience' WHEN c_mktsegment = 'FURNITURE' THEN 'other' ELSE 'projects_hackathons' END AS section, c_custkey % 3 AS sort_order, c_custkey AS story, c_name AS name FROM customer
), parts AS (
  SELECT o_custkey AS story, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AND o_orderkey % 5 > 0 THEN 'problem' WHEN o_orderkey % 3 = 0 THEN 'action' ELSE 'result' END AS kind, o_orderkey % 4 AS place, o_orderkey::VARCHAR AS component_id,
    ' Order ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE '' END AS text, 'Order ' || o_orderkey || '.' AS sentence, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 > 0 THEN 'seen ' || o_orderstatus ELSE '' END AS evidence_text, o_orderstatus = 'P' AS attested FROM orders
), packed AS (
  SELECT *, {'attested': attested, 'claim_ids': [o_orderkey], 'component_id': component_id, 'evidence_text': evidence_text, 'outcome_quote': CASE WHEN kind = 'result' THEN o_orderpriority END, 'place': place, 'text': text} AS p,
    {'claim_ids': [o_orderkey], 'component_id': component_id, 'text': sentence} AS b FROM parts
), nested AS (
  SELECT story, list(p ORDER BY place, component_id) FILTER (kind = 'problem') AS problem, coalesce(list(p ORDER BY place, component_id) FILTER (kind = 'action'), []) AS actions, coalesce(list(p ORDER BY place, component_id) FILTER (kind = 'result'), []) AS results,
    coalesce(list(b ORDER BY kind, place, component_id) FILTER (kind <> 'problem'), []) AS bullets FROM packed GROUP BY story
), entries AS (
  SELECT owner, section, list({'actions': actions, 'bullets': bullets, 'dates': '', 'entity': story, 'name': name, 'problem': problem[1], 'results': results, 'sort_order': sort_order, 'story': story, 'subtitle': NULL::VARCHAR} ORDER BY sort_order, story) AS entries
  FROM stories JOIN nested USING (story) WHERE section <> 'other' GROUP BY 1, 2
)
"""


def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every nation's snapshot, with the number of its entries."""
    found = snapshots.with_digest(snapshots.assemble(*_shown(spark, sf_dir)))
    return found.select("owner", F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["entries"])).alias("entries"), "digest")


SNAPSHOT_DIGESTS = f"""
WITH {_SHOWN}, owners AS (SELECT DISTINCT owner FROM entries)
SELECT owner, (len(coalesce(a.entries, [])) + len(coalesce(b.entries, [])))::INT AS entries, sha256(to_json([{{'entries': coalesce(a.entries, []), 'section': 'professional_experience'}}, {{'entries': coalesce(b.entries, []), 'section': 'projects_hackathons'}}])::VARCHAR) AS digest
FROM owners LEFT JOIN (SELECT * FROM entries WHERE section = 'professional_experience') a USING (owner) LEFT JOIN (SELECT * FROM entries WHERE section = 'projects_hackathons') b USING (owner)
"""


def snapshot_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as flat claims."""
    return snapshots.claims_of(snapshots.assemble(*_shown(spark, sf_dir)))


SNAPSHOT_CLAIMS = f"""
WITH {_SHOWN}, lead AS (SELECT story, arg_min(text, (place, component_id)) AS text, arg_min(evidence_text, (place, component_id)) AS evidence FROM parts WHERE kind = 'action' GROUP BY 1),
problem AS (SELECT story, text AS problem FROM parts WHERE kind = 'problem')
SELECT owner, CASE WHEN kind = 'action' THEN p.text ELSE l.text END AS action, problem, CASE WHEN kind = 'result' THEN p.text END AS result, 'story:' || story || ':' || component_id AS source_ref,
  CASE WHEN kind = 'action' THEN p.evidence_text ELSE concat_ws(chr(10), nullif(l.evidence, ''), nullif(p.evidence_text, '')) END AS evidence_text
FROM parts p JOIN stories USING (story) JOIN lead l USING (story) LEFT JOIN problem USING (story) WHERE kind <> 'problem' AND section <> 'other'
"""


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that come back from nested snapshots; those of stories without a section don't."""
    return snapshots.components_of(snapshots.assemble(*_shown(spark, sf_dir))).withColumn("claim_ids", F.array_join("claim_ids", ","))


ROUND_TRIP = f"""
WITH {_SHOWN}
SELECT story, kind, place, component_id, text, o_orderkey::VARCHAR AS claim_ids, CASE WHEN kind = 'result' THEN o_orderpriority END AS outcome_quote, evidence_text, attested FROM parts JOIN stories USING (story) WHERE section <> 'other'
"""


def unit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of customers' orders and of the lines behind them; and of the set of their priorities."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    claims = orders.select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("problem"), F.lit("ship").alias("action"), F.lit(None).cast("string").alias("result"), F.array(F.lit("a"), F.lit("b")).alias("flags"))
    evidence = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("unit"), F.lit("line").alias("source_type"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("source_ref"), F.col("l_partkey").cast("string").alias("text"))
    sets = orders.groupBy(F.col("o_custkey").alias("unit")).agg(snapshots.set_fingerprint(F.collect_list("o_orderpriority"), "v1").alias("priorities"))
    return snapshots.unit_fingerprints(claims, evidence).join(sets, "unit")


UNIT_PRINTS = """
WITH claims AS (SELECT o_custkey AS unit, list_sort(list(concat_ws(chr(31), o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END, 'ship', '', 'a,b'))) AS c, list_sort(list_distinct(list(lower(o_orderpriority)))) AS p FROM orders GROUP BY 1),
evidence AS (SELECT o_custkey AS unit, list_sort(list(concat_ws(chr(31), 'line', l_orderkey || '/' || l_linenumber, l_partkey))) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT unit, sha256(array_to_string(list_concat([unit::VARCHAR], c, ['--'], coalesce(e, [])), chr(30))) AS fingerprint, sha256(array_to_string(list_concat(['v1'], p), chr(30))) AS priorities FROM claims LEFT JOIN evidence USING (unit)
"""


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines, by number, are headings of three levels or text."""
    mark = lambda line, n: F.concat(F.when(n % 4 == 0, "# ").when(n % 4 == 3, "### ").when(n % 4 == 1, "## ").otherwise("x "), line)
    lines = F.transform(F.split(F.col("text"), "\n"), lambda line, n: mark(line, (n * 7 + F.col("doc_id")) % 11))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


_OUTLINE = r"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
marked AS (SELECT doc_id, n, line, CASE WHEN ((n * 7 + doc_id) % 11) % 4 = 0 THEN 1 WHEN ((n * 7 + doc_id) % 11) % 4 = 3 THEN 3 WHEN ((n * 7 + doc_id) % 11) % 4 = 1 THEN 2 END AS level FROM raw),
full_ AS (SELECT *, CASE level WHEN 1 THEN '# ' WHEN 2 THEN '## ' WHEN 3 THEN '### ' ELSE 'x ' END || line AS body, level IS NULL AND lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) IS NULL AS goes_on FROM marked),
runs AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq, sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(body) - 1 AS start FROM full_),
found AS (SELECT doc_id, seq, min(level) AS level, min(start) AS start, max(start + length(body)) AS past, string_agg(body, chr(10) ORDER BY n) AS body FROM runs GROUP BY 1, 2),
tree AS (
  SELECT *, max(seq) FILTER (level IS NOT NULL) OVER w AS last_any, max(seq) FILTER (level = 1) OVER w AS last1, max(seq) FILTER (level <= 2) OVER w AS last2 FROM found
  WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), linked AS (SELECT *, CASE WHEN level IS NULL THEN last_any WHEN level = 2 THEN last1 WHEN level = 3 THEN last2 END AS parent FROM tree),
"""


def heading_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of headings above every element of outlined documents, as a digest of all in order."""
    found = structure.heading_trails(structure.elements(_outlined(spark, sf_dir), "doc_id"), "doc_id")
    return found.select("doc_id", "seq", "kind", F.md5("trail").alias("trail"))


HEADING_TRAILS = f"""
WITH RECURSIVE {_OUTLINE} up AS (
  SELECT doc_id, seq, CASE WHEN level IS NULL THEN '' ELSE trim(substr(body, level + 1)) END AS trail, level IS NOT NULL AS any_, parent FROM linked
  UNION ALL SELECT u.doc_id, u.seq, trim(substr(l.body, l.level + 1)) || CASE WHEN any_ THEN ' > ' || trail ELSE '' END, true, l.parent FROM up u JOIN linked l ON l.doc_id = u.doc_id AND l.seq = u.parent
)
SELECT doc_id, seq, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, CASE WHEN any_ THEN md5(trail) END AS trail FROM up JOIN linked USING (doc_id, seq) WHERE up.parent IS NULL
"""


def outline_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the element trees of outlined documents."""
    return snapshots.tree_digests(structure.elements(_outlined(spark, sf_dir), "doc_id"), "doc_id")


OUTLINE_DIGESTS = f"""
WITH {_OUTLINE} lines AS (SELECT doc_id, seq, concat_ws('|', seq, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END, coalesce(level::VARCHAR, 'None'), coalesce(parent::VARCHAR, 'None'), start, past, sha256(body)) AS line FROM linked)
SELECT doc_id, count(*) AS elements, sha256(string_agg(line, chr(10) ORDER BY seq)) AS output_hash FROM lines GROUP BY 1
"""


def recorded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs compute of customers' sets of priorities and take from the record: on early orders, on all, and on all once more."""
    orders = table(spark, sf_dir, "orders")
    store = memo.Memo(spark, f"{shared_folder(spark)}/ledgerline/memo-{uuid.uuid4().hex}", "priorities long, urgent boolean", "v1")

    def compute(missing: DataFrame) -> DataFrame:
        return missing.select("fingerprint", F.size(F.array_distinct("spaces")).cast("long").alias("priorities"), F.array_contains("spaces", "1-URGENT").alias("urgent"))

    out = None
    for run, rows in enumerate((orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), orders, orders)):
        sets = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("spaces")).select(snapshots.set_fingerprint(F.col("spaces"), "v1").alias("fingerprint"), F.array_distinct("spaces").alias("spaces"))
        found, computed = store.get(sets, compute)
        told = sets.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("customers")).join(found, "fingerprint").select(F.lit(run).alias("run"), F.lit(computed).cast("long").alias("computed"), "fingerprint", "customers", "priorities", "urgent")
        out = told if out is None else out.unionByName(told)
    return out


RECORDED_GROUPS = """
WITH sets AS (
  SELECT run, o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders, range(3) t(run) WHERE run > 0 OR o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2
), prints AS (SELECT run, sha256('v1' || chr(30) || lower(array_to_string(s, chr(30)))) AS fingerprint, len(s) AS priorities, list_contains(s, '1-URGENT') AS urgent, count(*) AS customers FROM sets GROUP BY ALL),
firsts AS (SELECT fingerprint, min(run) AS run FROM prints GROUP BY 1)
SELECT run::INT AS run, (SELECT count(*) FROM firsts f WHERE f.run = p.run) AS computed, fingerprint, customers, priorities, urgent FROM prints p
"""

def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and their lines as spans, which are broken in four ways by number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    in_order = W.partitionBy("doc_id").orderBy("n")
    spans = lines.withColumns({"end": (F.sum(F.length("body") + 1).over(in_order) - 1).cast("int"), "last": F.lead("n").over(in_order).isNull()})
    kind, first = F.col("doc_id") % 7, F.col("n") == 0
    spans = spans.withColumn("start", F.col("end") - F.length("body")).where(~((kind == 0) & first))
    return docs, spans.select(
        "doc_id", (F.col("start") - F.when((kind == 2) & (F.col("n") == 1), 2).otherwise(0)).alias("start"), (F.col("end") + F.when((kind == 3) & F.col("last"), 5).otherwise(0)).alias("end"),
        F.when((kind == 1) & first, "x").otherwise(F.col("body")).alias("body"),
    )


_SPANS = """
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, sum(length(body) + 1) OVER w - 1 AS past, lead(n) OVER w IS NULL AS last FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
faults AS (
  SELECT doc_id, CASE WHEN last THEN 0 ELSE past + 1 END AS start, 'gap' AS reason FROM placed WHERE doc_id % 7 = 0 AND n = 0 AND trim(body, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
  UNION ALL SELECT doc_id, 0, 'not_the_slice' FROM placed WHERE doc_id % 7 = 1 AND n = 0 AND body <> 'x' AND past > 0
  UNION ALL SELECT doc_id, past - length(body) - 2, CASE WHEN past - length(body) - 2 < 0 THEN 'out_of_bounds' ELSE 'overlap' END FROM placed WHERE doc_id % 7 = 2 AND n = 1
  UNION ALL SELECT doc_id, past - length(body), 'out_of_bounds' FROM placed WHERE doc_id % 7 = 3 AND last
  UNION ALL SELECT doc_id, past, 'out_of_bounds' FROM placed WHERE length(body) = 0 AND doc_id % 7 NOT IN (0, 1, 2, 3)
)
"""


def broken_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with spans of lines that were broken on purpose."""
    return segments.coverage_violations(*_lines(spark, sf_dir), "doc_id")


BROKEN_COVERAGE = f"WITH {_SPANS} SELECT doc_id, start::INT AS start, reason FROM faults"


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, spans = _lines(spark, sf_dir)
    k = F.col("doc_id")
    objects = docs.select(k.alias("source_id"), F.when(k % 13 > 0, F.col("text")).alias("raw"), F.when(k % 11 > 0, F.sha2("text", 256)).otherwise("other").alias("content_hash"), F.when(k % 17 == 0, "failed").alias("status"), F.when(k % 19 > 0, k.cast("string")).alias("location"))
    faults = segments.coverage_violations(docs, spans, "doc_id").withColumnRenamed("doc_id", "source_id")
    trees = spans.where(k % 23 > 0).groupBy(k.alias("source_id")).agg(F.count(F.lit(1)).alias("elements"), F.md5(F.max("body")).alias("output_hash"))
    return objects, faults, trees


def reconciled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents as objects, each fault by number."""
    found = ledger.reconciled(*_objects(spark, sf_dir))
    return found.withColumn("failures", F.array_join("failures", ","))


_LEDGER = f"""
{_SPANS}, told AS (SELECT doc_id, list('structure:' || reason ORDER BY start)[1:5] AS fs FROM faults GROUP BY 1),
trees AS (SELECT doc_id, count(*) AS n, md5(max(CASE WHEN doc_id % 7 = 1 AND n = 0 THEN 'x' ELSE body END)) AS h FROM placed WHERE doc_id % 23 > 0 AND NOT (doc_id % 7 = 0 AND n = 0) GROUP BY 1),
objects AS (SELECT doc_id, coalesce(doc_id % 13 > 0 AND text IS NOT NULL, false) AS there, text, coalesce(fs, []) AS fs, coalesce(n, 0) AS n, h FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN trees USING (doc_id)),
flagged AS (SELECT *, there AND doc_id % 11 > 0 AS hash_ok, there AND doc_id % 17 > 0 AS extracted, there AND len(fs) = 0 AND n = 0 AND trim(text) <> '' AS bare, there AND doc_id % 19 > 0 AS pointed FROM objects),
done AS (
  SELECT *, there AND len(fs) = 0 AND NOT bare AS complete, concat_ws(',', CASE WHEN NOT there THEN 'no_capture' END, CASE WHEN there AND NOT hash_ok THEN 'hash_mismatch' END, CASE WHEN there AND NOT extracted THEN 'extraction_failed' END,
    CASE WHEN there AND len(fs) > 0 THEN array_to_string(fs, ',') END, CASE WHEN bare THEN 'no_elements' END, CASE WHEN there AND NOT pointed THEN 'no_provenance' END) AS failures FROM flagged
)
"""
RECONCILED_OBJECTS = f"""
WITH {_LEDGER} SELECT doc_id AS source_id, there AS raw_captured, hash_ok AS hash_verified, extracted AS extraction_complete, complete AS structure_complete, pointed AS provenance_complete, n AS element_count, CASE WHEN complete THEN h END AS output_hash, failures,
  CASE WHEN failures = '' THEN 'ok' ELSE 'failed' END AS status FROM done
"""


def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rollup(ledger.reconciled(*_objects(spark, sf_dir)))


LEDGER_ROLLUP = f"""
WITH {_LEDGER}, pct AS (SELECT count(*) AS objects, count(*) FILTER (failures <> '') AS failed, bool_and(failures = '') AS passed, {", ".join(f"round(100.0 * avg({c}::INT), 3) AS {n}_pct" for c, n in [("there", "raw_captured"), ("hash_ok", "hash_verified"), ("extracted", "extraction_complete"), ("complete", "structure_complete"), ("pointed", "provenance_complete")])} FROM done)
SELECT * FROM pct
"""

QUERIES = {
    "snapshot_digests": (snapshot_digests, SNAPSHOT_DIGESTS), "snapshot_claims": (snapshot_claims, SNAPSHOT_CLAIMS), "round_trip": (round_trip, ROUND_TRIP), "unit_prints": (unit_prints, UNIT_PRINTS),
    "heading_trails": (heading_trails, HEADING_TRAILS), "outline_digests": (outline_digests, OUTLINE_DIGESTS), "recorded_groups": (recorded_groups, RECORDED_GROUPS),
    "broken_coverage": (broken_coverage, BROKEN_COVERAGE), "reconciled_objects": (reconciled_objects, RECONCILED_OBJECTS), "ledger_rollup": (ledger_rollup, LEDGER_ROLLUP),
}
