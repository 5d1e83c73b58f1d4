"""Queries that apply plans of changes to several tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import changes, choice, edits
from ledgerline.tables import dealt, parts, table

SPLIT_DAY = "1998-01-01"


def _claims_and_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as claims, and an edit for every order with lines, made from these."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    paid = F.when(F.col("o_totalprice") > 250000, F.lit("paid"))
    claims = orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending_review").alias("status"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("late: "), F.col("o_orderpriority"))).alias("problem_text"), F.lit(None).cast("string").alias("cost_dimension"),
        F.lit(None).cast("string").alias("inefficiency"), F.concat(F.lit("ship "), F.col("o_orderkey").cast("string")).alias("action_text"), F.array(F.lit("van")).alias("action_tools"),
        paid.alias("result_text"), F.when(paid.isNull(), "missing").otherwise("qualitative_evidenced").alias("result_kind"), F.lit("unverified").alias("result_status"),
        F.lit(None).cast("string").alias("metric"), F.array(F.lit("no_tools")).alias("flags"),
    )
    n = F.col("n").cast("string")
    counted = dealt(lines, "l_orderkey").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_returnflag").alias("flag"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("most"), F.min("l_tax").alias("least")
    )
    asked = counted.select(
        F.col("l_orderkey").alias("id"), F.when(F.col("n") == 1, "  ").when(F.col("flag") == "R", "lines came back").alias("problem_text"), F.when((F.col("n") % 5 == 0), "cost").alias("cost_dimension"),
        F.lit(None).cast("string").alias("inefficiency"), F.when(F.col("n") >= 6, F.concat(F.lit("split in "), n)).when((F.col("n") == 2) & (F.col("flag") == "A"), "").alias("action_text"),
        F.when(F.col("n") == 4, F.array(F.lit("crane"), F.lit("van"))).alias("action_tools"), F.when(F.col("discount") >= 0.09, F.concat(F.lit("saved "), n)).alias("result_text"),
        F.when(F.col("n") == 3, "missing").when((F.col("discount") >= 0.09) & (F.col("least") < 0.03), "quantified").when(F.col("most") >= 0.08, "qualitative_evidenced").alias("result_kind"),
        F.when(F.col("n") == 7, '{"n": 7}').alias("metric"),
    )
    return claims, asked


_CLAIMS = """
claims AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending_review' END AS status, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'late: ' || o_orderpriority END AS problem_text,
    'ship ' || o_orderkey AS action_text, CASE WHEN o_totalprice > 250000 THEN 'paid' END AS result_text, CASE WHEN o_totalprice > 250000 THEN 'qualitative_evidenced' ELSE 'missing' END AS result_kind FROM orders
), counted AS (SELECT l_orderkey AS id, count(*) AS n, max(l_returnflag) AS flag, max(l_discount) AS discount, max(l_tax) AS most, min(l_tax) AS least FROM lineitem GROUP BY 1),
asked AS (
  SELECT id, CASE WHEN n = 1 THEN '  ' WHEN flag = 'R' THEN 'lines came back' END AS p, CASE WHEN n % 5 = 0 THEN 'cost' END AS dimension,
    CASE WHEN n >= 6 THEN 'split in ' || n WHEN n = 2 AND flag = 'A' THEN '' END AS a, CASE WHEN n = 4 THEN 'crane,van' END AS tools, CASE WHEN discount >= 0.09 THEN 'saved ' || n END AS r,
    CASE WHEN n = 3 THEN 'missing' WHEN discount >= 0.09 AND least < 0.03 THEN 'quantified' WHEN most >= 0.08 THEN 'qualitative_evidenced' END AS kind, CASE WHEN n = 7 THEN '{"n": 7}' END AS metric FROM counted
), parts AS (
  SELECT *, p IS NOT NULL OR dimension IS NOT NULL AS ep, a IS NOT NULL OR tools IS NOT NULL AS ea, r IS NOT NULL OR kind IS NOT NULL OR metric IS NOT NULL AS er,
    coalesce(p, problem_text) AS np, coalesce(a, action_text) AS na, coalesce(r, result_text) AS nr FROM claims JOIN asked USING (id)
), checked AS (
  SELECT *, CASE WHEN status <> 'pending_review' THEN 'not_editable' WHEN NOT (ep OR ea OR er) THEN 'no_edits' WHEN kind = 'missing' THEN 'kind_missing' WHEN r IS NOT NULL AND kind IS NULL THEN 'kind_needed'
    WHEN kind IS NOT NULL AND r IS NULL AND result_text IS NULL THEN 'text_needed' WHEN ep AND trim(coalesce(np, '')) = '' THEN 'problem_empty' WHEN ea AND trim(coalesce(na, '')) = '' THEN 'action_empty'
    WHEN er AND trim(coalesce(nr, '')) = '' THEN 'result_empty' END AS refused FROM parts
)
"""


def edited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, attestations and links after every edit that may be made: one plan over three tables."""
    claims, asked = _claims_and_edits(spark, sf_dir)
    plan = edits.edit_changes(edits.checked_edits(claims, asked))
    none = spark.createDataFrame([], "source_type string, source_ref string, text string")
    links = spark.createDataFrame([], "id long, source_type string, source_ref string, field string, quote string")
    order = {"claims": 0, "evidence": 1, "links": 2}
    plan = plan.withColumn("place", sum((F.when(F.col("target") == t, k).otherwise(0) for t, k in order.items()), F.lit(0)).cast("long"))
    after, _ = changes.apply_changes({"claims": changes.Target(claims, ["id"], F.col("status") != "pending_review"), "evidence": changes.Target(none, ["source_type", "source_ref"]), "links": changes.Target(links, ["id", "source_type", "source_ref", "field"])}, plan)
    c = after["claims"].select(
        F.lit("claim").alias("kind"), F.col("id").cast("string").alias("id"), F.col("problem_text").alias("a"), F.col("action_text").alias("b"), F.col("result_text").alias("c"),
        F.concat_ws("|", "result_kind", "result_status", "cost_dimension", F.array_join("action_tools", ","), "metric", F.size("flags").cast("string")).alias("d"),
    )
    empty = F.lit(None).cast("string")
    e = after["evidence"].select(F.lit("evidence").alias("kind"), F.col("source_ref").alias("id"), F.col("source_type").alias("a"), F.col("text").alias("b"), empty.alias("c"), empty.alias("d"))
    k = after["links"].select(F.lit("link").alias("kind"), F.col("id").cast("string").alias("id"), F.col("source_ref").alias("a"), F.col("field").alias("b"), F.col("quote").alias("c"), empty.alias("d"))
    return c.unionByName(e).unionByName(k)


EDITED_CLAIMS = f"""
WITH {_CLAIMS}, done AS (SELECT * FROM checked WHERE refused IS NULL),
said AS (
  SELECT id, 'problem' AS field, np AS text FROM done WHERE ep UNION ALL SELECT id, 'action', na FROM done WHERE ea UNION ALL SELECT id, 'result', nr FROM done WHERE er
)
SELECT 'claim' AS kind, id::VARCHAR AS id, CASE WHEN d.ep THEN d.np ELSE c.problem_text END AS a, CASE WHEN d.ea THEN d.na ELSE c.action_text END AS b, CASE WHEN d.er THEN d.nr ELSE c.result_text END AS c,
  concat_ws('|', CASE WHEN d.er THEN coalesce(d.kind, d.result_kind) ELSE c.result_kind END, CASE WHEN d.er THEN 'user_attested' ELSE 'unverified' END, d.dimension, coalesce(d.tools, 'van'), d.metric, CASE WHEN d.id IS NULL THEN '1' ELSE '0' END) AS d
FROM claims c LEFT JOIN done d USING (id)
UNION ALL SELECT 'evidence', 'claim:' || id || ':' || field, 'user_attestation', text, NULL, NULL FROM said
UNION ALL SELECT 'link', id::VARCHAR, 'claim:' || id || ':' || field, field, CASE WHEN field = 'result' THEN text END, NULL FROM said
"""


def refused_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by the first reason against them."""
    claims, asked = _claims_and_edits(spark, sf_dir)
    return edits.checked_edits(claims, asked).select("id", "refused")


REFUSED_EDITS = f"WITH {_CLAIMS} SELECT id, refused FROM checked UNION ALL SELECT id, 'unknown_claim' FROM asked WHERE id NOT IN (SELECT id FROM claims)"


def _plan(spark: SparkSession, sf_dir: str) -> tuple[dict[str, changes.Target], DataFrame]:
    """Stories, entities and packets of earlier orders, and the plan that later orders make."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    named = orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("space"), "o_orderkey", "o_orderstatus", (F.col("o_orderdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz")).alias("early"))
    state = F.when(F.max("o_orderstatus") == "F", "approved").when((F.max("o_orderstatus") == "P") & (F.count(F.lit(1)) > 1), "excluded").otherwise("draft")
    stories = named.where("early").groupBy("entity", "space").agg(F.max("o_orderkey").cast("string").alias("content"), state.alias("status"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.lit(None).cast("string").alias("note"))
    units = named.where("not early").groupBy("entity", "space").agg(F.max("o_orderkey").cast("string").alias("content"))
    answered = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("entity")).join(stories.select("entity", "space"), "entity")
    entities = customers.select(F.col("c_custkey").alias("entity"), F.lit(None).cast("string").alias("extraction_hash"))
    seen = units.groupBy("entity").agg(F.md5(F.array_join(F.array_sort(F.collect_list("content")), ",")).alias("extraction_hash"))
    packets = named.where("early").groupBy((F.col("o_orderkey") % 1000).alias("interview")).agg(F.lit("old").alias("content"))
    late = named.where("not early").groupBy((F.col("o_orderkey") % 2000).alias("interview")).agg(F.max("o_orderkey").cast("string").alias("content"))
    interviews = orders.where("o_orderstatus <> 'P'").select((F.col("o_orderkey") % 2000).alias("interview")).distinct()
    reasons = customers.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("entity"), F.lit("new evidence").alias("reason"))
    plan = edits.draft_changes(stories, units, answered).unionByName(edits.stamps(seen, "entities", ["entity"], ["extraction_hash"], 1)).unionByName(edits.packet_changes(late))
    plan = plan.unionByName(edits.invalidations(stories, reasons).withColumn("place", F.lit(2).cast("long")))
    targets = {
        "stories": changes.Target(stories, ["entity", "space"], F.col("status").isin(edits.DECIDED)), "entities": changes.Target(entities, ["entity"]), "packets": changes.Target(packets, ["interview"], parent=interviews),
    }
    return targets, plan


_PLAN = f"""
named AS (SELECT o_custkey AS entity, o_orderpriority AS space, o_orderkey, o_orderstatus, o_orderdate < TIMESTAMP '{SPLIT_DAY} 00:00:00' AS early FROM orders),
stories AS (SELECT entity, space, max(o_orderkey)::VARCHAR AS content, CASE WHEN max(o_orderstatus) = 'F' THEN 'approved' WHEN max(o_orderstatus) = 'P' AND count(*) > 1 THEN 'excluded' ELSE 'draft' END AS status FROM named WHERE early GROUP BY 1, 2),
units AS (SELECT entity, space, max(o_orderkey)::VARCHAR AS content FROM named WHERE NOT early GROUP BY 1, 2),
machinery AS (SELECT c_custkey AS entity FROM customer WHERE c_mktsegment = 'MACHINERY'),
both_ AS (
  SELECT entity, space, s.content AS old, u.content AS new, s.status, s.status IN ('approved', 'excluded') AS decided, entity IN (SELECT entity FROM units) AS in_run, entity IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS answered,
    entity IN (SELECT entity FROM machinery) AS invalid FROM stories s FULL JOIN units u USING (entity, space)
), drafts AS (
  SELECT *, CASE WHEN new IS NOT NULL AND decided THEN 'decided' WHEN new IS NOT NULL THEN 'written' WHEN in_run AND NOT answered AND decided THEN 'kept' WHEN in_run AND NOT answered THEN 'deleted' END AS did FROM both_
), late AS (SELECT o_orderkey % 2000 AS interview, max(o_orderkey)::VARCHAR AS content FROM named WHERE NOT early GROUP BY 1),
packets AS (SELECT DISTINCT o_orderkey % 1000 AS interview FROM named WHERE early), interviews AS (SELECT DISTINCT o_orderkey % 2000 AS interview FROM orders WHERE o_orderstatus <> 'P')
"""


def applied_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories, entities and packets after one plan: drafts anew, stale drafts gone, invalidations, stamps, and packets only of known interviews."""
    after, _ = changes.apply_changes(*_plan(spark, sf_dir))
    text = lambda c: F.col(c).cast("string")
    out = after["stories"].select(F.lit("stories").alias("target"), F.concat_ws("/", text("entity"), "space").alias("key"), F.concat_ws("/", "content", "status").alias("content"), "note")
    out = out.unionByName(after["entities"].select(F.lit("entities").alias("target"), text("entity").alias("key"), F.col("extraction_hash").alias("content"), F.lit(None).cast("string").alias("note")))
    return out.unionByName(after["packets"].select(F.lit("packets").alias("target"), text("interview").alias("key"), "content", F.lit(None).cast("string").alias("note")))


APPLIED_PLAN = f"""
WITH {_PLAN}
SELECT 'stories' AS target, entity || '/' || space AS key, (CASE WHEN did = 'written' THEN new ELSE old END) || '/' || (CASE WHEN invalid AND status IS NOT NULL THEN 'draft' WHEN did = 'written' THEN 'pending_review' ELSE status END) AS content,
  CASE WHEN invalid AND status IS NOT NULL THEN 'invalidated: new evidence' || CASE WHEN decided THEN ' (previously ' || status || ' at unknown time)' ELSE '' END END AS note
FROM drafts WHERE did IS DISTINCT FROM 'deleted'
UNION ALL SELECT 'entities', c_custkey::VARCHAR, h, NULL FROM customer LEFT JOIN (SELECT entity, md5(array_to_string(list_sort(list(content)), ',')) AS h FROM units GROUP BY 1) ON entity = c_custkey
UNION ALL SELECT 'packets', interview::VARCHAR, CASE WHEN p.interview IS NULL THEN l.content ELSE coalesce(l.content, 'old') END, NULL
FROM packets p FULL JOIN late l USING (interview) WHERE p.interview IS NOT NULL OR interview IN (SELECT interview FROM interviews)
"""


def plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the changes of the plan."""
    _, log = changes.apply_changes(*_plan(spark, sf_dir))
    return log.groupBy("target", "op", "outcome").agg(F.count(F.lit(1)).alias("changes"))


PLAN_OUTCOMES = f"""
WITH {_PLAN}
SELECT 'stories' AS target, CASE WHEN new IS NULL THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN decided THEN 'decided' ELSE 'applied' END AS outcome, count(*) AS changes FROM drafts WHERE did IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'stories', 'update', CASE WHEN did = 'deleted' THEN 'absent' ELSE 'applied' END, count(*) FROM drafts WHERE invalid AND status IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'entities', 'update', 'applied', count(DISTINCT entity) FROM units
UNION ALL SELECT 'packets', 'upsert', CASE WHEN interview IN (SELECT interview FROM packets) OR interview IN (SELECT interview FROM interviews) THEN 'applied' ELSE 'no_parent' END, count(*) FROM late GROUP BY ALL
"""

def independent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer, in order, of which each brand backs one at most; an order that is not kept holds no brand."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = parts(lines, orders)
    branded = lines.repartition(n, "l_partkey").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    brands = branded.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brands"))
    orders = orders.repartition(n, "o_orderkey").join(brands, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", "brands")
    drafts = choice.kept_in_order(orders, ["o_custkey"], "o_orderkey", "brands")
    return drafts.select("o_custkey", "o_orderkey", "kept")


INDEPENDENT_ORDERS = """
WITH RECURSIVE spans AS (
  SELECT o_custkey, o_orderkey, coalesce(brands, []) AS brands, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
  FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON o_orderkey = l_orderkey
), walk AS (
  SELECT o_custkey, o_orderkey, n, brands AS held, true AS kept FROM spans WHERE n = 1
  UNION ALL
  SELECT s.o_custkey, s.o_orderkey, s.n, CASE WHEN list_has_any(w.held, s.brands) THEN w.held ELSE list_concat(w.held, s.brands) END, NOT list_has_any(w.held, s.brands)
  FROM walk w JOIN spans s ON s.o_custkey = w.o_custkey AND s.n = w.n + 1
)
SELECT o_custkey, o_orderkey, kept FROM walk
"""


def new_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as drafts of their nation, against suppliers as claims that stand; nations take their turns by key, those of one region have none."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    print_of = lambda balance: F.floor(F.col(balance) / 40).cast("string")
    drafts = customer.select(F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("place"), print_of("c_acctbal").alias("fingerprint"))
    existing = supplier.select(F.col("s_nationkey").alias("entity"), (F.col("s_suppkey") % 3 == 0).alias("reviewed"), print_of("s_acctbal").alias("fingerprint"))
    runs = nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("entity"), F.col("n_nationkey").alias("turn"))
    return choice.new_content(drafts, existing, runs).select(F.col("place").alias("c_custkey"), "entity", "duplicate")


NEW_ACCOUNTS = """
WITH old AS (
  SELECT floor(s_acctbal / 40)::BIGINT AS f, bool_or(s_suppkey % 3 = 0) AS decided, coalesce(bool_or(s_suppkey % 3 <> 0 AND n_regionkey = 2), false) AS elsewhere,
    max(s_nationkey) FILTER (s_suppkey % 3 <> 0 AND n_regionkey <> 2) AS last_turn FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
), judged AS (
  SELECT c_custkey, c_nationkey AS entity, floor(c_acctbal / 40)::BIGINT AS f,
    CASE WHEN n_regionkey = 2 THEN 'no_turn' WHEN decided THEN 'decided' WHEN elsewhere OR c_nationkey < last_turn THEN 'queued_elsewhere' END AS duplicate
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN old ON floor(c_acctbal / 40)::BIGINT = f
)
SELECT c_custkey, entity, CASE WHEN duplicate IS NULL AND row_number() OVER (PARTITION BY f, duplicate IS NULL ORDER BY entity, c_custkey) > 1 THEN 'earlier_draft' ELSE duplicate END AS duplicate FROM judged
"""

QUERIES = {
    "edited_claims": (edited_claims, EDITED_CLAIMS), "refused_edits": (refused_edits, REFUSED_EDITS), "applied_plan": (applied_plan, APPLIED_PLAN), "plan_outcomes": (plan_outcomes, PLAN_OUTCOMES),
    "independent_orders": (independent_orders, INDEPENDENT_ORDERS), "new_accounts": (new_accounts, NEW_ACCOUNTS),
}
