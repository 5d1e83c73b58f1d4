"""Queries over records: links, decisions, logs and generations of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import audits, lifecycle, ranking, states, stories
from ledgerline.plans import sqltext as S
from ledgerline.sources import scan
from ledgerline.tables import dealt, table

#: Rows of an earlier and a later generation are told apart by these.
SPLIT_DAY, STALE_DAY = "1998-01-01", "2024-01-29"
STEPS = [("view", "click"), ("click", "purchase"), ("view", "purchase"), ("signup", "view"), ("purchase", "view")]


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return scan.changed_since(rows, F.col("ts"), F.lit(f"{STALE_DAY} 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id", "event_type")


RECENT_EVENTS = f"SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '{STALE_DAY} 00:00:00'"


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the first reason to leave them out."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    why = scan.repo_exclusion(F.col("c_acctbal") < 0, F.col("c_mktsegment") == "MACHINERY", F.col("n_name"), "France")
    return rows.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("customers"))


EXCLUSION_REASONS = """
SELECT CASE WHEN c_acctbal < 0 THEN 'fork_excluded' WHEN c_mktsegment = 'MACHINERY' THEN 'private_excluded' WHEN lower(n_name) <> 'france' THEN 'owner_out_of_scope' END AS reason, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
"""


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, ranked per customer by price; orders without a customer are dropped."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(W.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return joined.select("o_orderkey", "c_custkey", "c_name", rank.alias("rank"))


ORDER_LINKS = "SELECT o_orderkey, c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders JOIN customer ON o_custkey = c_custkey"


def nested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the sorted distinct parts of its lines; an empty list for none."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("parts"), F.count(F.lit(1)).alias("lines"))
    return table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("parts", F.lit("")).alias("parts"), F.coalesce("lines", F.lit(0)).alias("lines"))


NESTED_LINKS = """
SELECT o_orderkey, coalesce(parts, '') AS parts, coalesce(lines, 0) AS lines FROM orders
LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts, count(*) AS lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
"""


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to suppliers over lines and parts, each pair once with its first line."""
    lines, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    walk = table(spark, sf_dir, "orders").join(dealt(lines, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return walk.groupBy("o_orderkey", "s_suppkey").agg(F.min("l_linenumber").alias("first_line"))


PROVENANCE = """
SELECT o_orderkey, s_suppkey, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, and lines whose order isn't there."""
    orders = table(spark, sf_dir, "orders")
    lonely = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    dangling = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"))
    return lonely.unionByName(dangling.distinct())


ORPHANS = """
SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT 'line', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
"""


def _active(docs: DataFrame) -> DataFrame:
    """Documents with the id of the first of equal texts."""
    first = docs.groupBy(F.xxhash64("text").alias("k"), F.md5("text").alias("m")).agg(F.min("doc_id").alias("first_id"))
    return docs.withColumns({"k": F.xxhash64("text"), "m": F.md5("text")}).join(first, ["k", "m"]).drop("k", "m")


def decided_on_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on documents that an earlier one with the same text has replaced."""
    docs = _active(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").where("doc_id <> first_id").select("doc_id", "quality", "first_id")


DECIDED_ON_STALE = """
SELECT doc_id, quality, first_id FROM labels JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) USING (doc_id) WHERE doc_id <> first_id
"""


def first_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every text, apart from white space and case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normal_key(F.col("text")).alias("t"))
    return docs.groupBy(F.xxhash64("t"), F.md5("t").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("key", "doc_id", "copies")


FIRST_OF_TEXT = f"SELECT md5(t) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, lower({S.squeezed('text')}) AS t FROM documents) GROUP BY t"


def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("f"))
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("f").alias("texts"))
    return counted.select("source", "documents", (F.col("documents") - F.col("texts")).alias("duplicates"), audits.share(F.col("documents") - F.col("texts"), F.col("documents")).alias("rate"))


DUPLICATE_RATE = "SELECT source, count(*) AS documents, count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text)) / count(*), 4) AS rate FROM documents GROUP BY source"


def slop_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    words = F.size(X.tokens(F.col("text")))
    return audits.slop(docs, words < 5, F.length("text") < 100, F.md5("text"), F.col("quality").isNull(), F.col("toxic") == 1)


SLOP_SCORECARD = f"""
WITH d AS (SELECT text, len({S.tokens("text")}) AS words, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
c AS (
  SELECT count(*) AS total, count(*) FILTER (words < 5) AS fragments, count(*) FILTER (length(text) < 100) AS unspecific, count(*) - count(DISTINCT text) AS duplicates,
    count(*) FILTER (quality IS NULL) AS missing_results, count(*) FILTER (toxic = 1) AS flagged FROM d
)
SELECT *, round(fragments / total, 4) AS fragments_rate, round(unspecific / total, 4) AS unspecific_rate, round(duplicates / total, 4) AS duplicates_rate,
  round(missing_results / total, 4) AS missing_results_rate, round(flagged / total, 4) AS flagged_rate FROM c
"""


def golden_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return audits.golden_summary(rows, F.col("quality") == 1, F.col("quality") == 0, F.col("source"))


GOLDEN_SUMMARY = """
WITH r AS (SELECT quality, source FROM labels JOIN documents USING (doc_id)), t AS (SELECT count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS rejected FROM r)
SELECT source AS reason, count(*) AS times, any_value(approved) AS approved, any_value(rejected) AS rejected FROM r, t WHERE quality = 0 GROUP BY source ORDER BY times DESC, reason LIMIT 5
"""


def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions per language in exclusive buckets, and counts that should be zero."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    return rows.groupBy("lang").agg(
        F.count_if(q == 1).alias("approved"), F.count_if(q == 0).alias("rejected"), F.count_if(q.isNull()).alias("undecided"), F.count_if((q == 0) & (t == 1)).alias("both_gaps"),
        F.count_if((q == 0) & (t == 0)).alias("quality_gap"), F.count_if((q == 1) & (t == 1)).alias("toxic_gap"), F.count_if(q.isNull() & t.isNotNull()).alias("half_decided"),
        audits.percent(q.isNotNull()).alias("decided_pct"),
    )


DECISION_REPORT = """
SELECT lang, count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (quality IS NULL) AS undecided, count(*) FILTER (quality = 0 AND toxic = 1) AS both_gaps,
  count(*) FILTER (quality = 0 AND toxic = 0) AS quality_gap, count(*) FILTER (quality = 1 AND toxic = 1) AS toxic_gap, count(*) FILTER (quality IS NULL AND toxic IS NOT NULL) AS half_decided,
  round(100.0 * avg(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END), 3) AS decided_pct
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
"""


def duplicate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines beyond the first of each (order, line number), per supplier of the first."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) - 1).alias("extra"), F.min("l_suppkey").alias("supplier"))
    return counted.groupBy("supplier").agg(F.sum("extra").alias("extra"), F.count(F.lit(1)).alias("objects"))


DUPLICATE_OBJECTS = """
SELECT supplier, CAST(sum(extra) AS BIGINT) AS extra, count(*) AS objects FROM (SELECT count(*) - 1 AS extra, min(l_suppkey) AS supplier FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY supplier
"""


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


LATEST_ORDERS = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1"


def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' next snapshot version if the state of their account is a snapshot's digest."""
    orders = table(spark, sf_dir, "orders")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    past = orders.select("o_custkey", F.col("o_orderstatus").alias("digest"), place.alias("version"))
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, "F").otherwise("O").alias("digest"))
    return lifecycle.next_version(past, now, "o_custkey", "digest")


VERSION_NUMBERS = """
WITH past AS (SELECT o_custkey, o_orderstatus AS digest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders),
last AS (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) = 1),
now AS (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'O' END AS digest FROM customer)
SELECT now.o_custkey, now.digest, CAST(CASE WHEN version IS NULL THEN 1 WHEN last.digest = now.digest THEN version ELSE version + 1 END AS INTEGER) AS version FROM now LEFT JOIN last USING (o_custkey)
"""


def leverage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by status, urgency, price, date, length of priority and id."""
    leverage = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "P", 3).otherwise(1)
    order = [F.desc(leverage), F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1), F.desc("o_totalprice"), F.desc_nulls_last("o_orderdate"), F.length("o_orderpriority"), F.col("o_orderkey")]
    ranked = table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(*order)))
    return ranked.where("place <= 5").select("o_custkey", "o_orderkey", "place")


LEVERAGE_RANKS = """
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 3 ELSE 1 END DESC, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END,
    o_totalprice DESC, o_orderdate DESC NULLS LAST, length(o_orderpriority), o_orderkey) AS place FROM orders
) WHERE place <= 5
"""


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' latest orders before and from a day on, as rows of an old and a new generation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    day = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return tuple(lifecycle.latest(orders.where(side), ["o_custkey"], order).drop("o_orderdate") for side in (F.col("o_orderdate") < day, F.col("o_orderdate") >= day))


_GENERATIONS = f"""
old AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DAY}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
new AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT_DAY}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
"""


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new generation merged into the old; finished orders are decided and stay."""
    old, new = _generations(spark, sf_dir)
    return lifecycle.upsert(old, new, ["o_custkey"], F.col("o_orderstatus") == "F")


MERGED_ORDERS = f"""
WITH {_GENERATIONS}
SELECT o_custkey, CASE WHEN n.o_orderkey IS NULL OR coalesce(o.o_orderstatus = 'F', false) THEN o.o_orderkey ELSE n.o_orderkey END AS o_orderkey,
  CASE WHEN n.o_orderkey IS NULL OR coalesce(o.o_orderstatus = 'F', false) THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus
FROM old o FULL OUTER JOIN new n USING (o_custkey)
"""


def inserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _generations(spark, sf_dir)
    return lifecycle.insert_absent(old, new, ["o_custkey"])


INSERTED_ORDERS = f"WITH {_GENERATIONS} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM old)"


def unreviewed_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents stay; of the others each text that no labelled one has stays once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("fingerprint"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("decided"))
    rows = docs.join(labels, "id", "left").withColumn("decided", F.coalesce("decided", F.lit(False)))
    return lifecycle.replace_unreviewed(rows, rows.where("not decided"), F.col("decided"), ["fingerprint"])


UNREVIEWED_REPLACED = """
WITH r AS (SELECT d.doc_id AS id, md5(text) AS fingerprint, l.doc_id IS NOT NULL AS decided FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT * FROM r WHERE decided
UNION ALL SELECT id, fingerprint, decided FROM r WHERE NOT decided AND fingerprint NOT IN (SELECT fingerprint FROM r WHERE decided) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1
"""


def changed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines differ from a ledger that has those shipped before a day alone."""
    def states_of(lines: DataFrame) -> DataFrame:
        text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey"))), ";")
        return lines.groupBy("l_orderkey").agg(F.sha2(text, 256).alias("digest"))

    lines = table(spark, sf_dir, "lineitem")
    return lifecycle.changed(states_of(lines), states_of(lines.where(F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz"))), ["l_orderkey"], "digest")


_LINES = "sha256(array_to_string(list_sort(list(l_linenumber || ':' || l_partkey || ':' || l_suppkey)), ';'))"
CHANGED_ORDERS = f"""
SELECT l_orderkey, {_LINES} AS digest FROM lineitem GROUP BY 1 EXCEPT SELECT l_orderkey, {_LINES} FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DAY}' GROUP BY 1
"""


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of conversations: the old generation has all of them, the new one whole, halved or joined ones."""
    turns = table(spark, sf_dir, "conversations")
    pin = F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string"))
    existing = turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("conv_id").alias("doc"), F.col("text").alias("body"), F.lit(True).alias("is_active"), pin.alias("pinned"))
    body = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.concat(F.lit("more "), "text"))
    fresh = turns.where("turn <> 4").select(F.concat_ws("/", "conv_id", "turn", F.lit("new")).alias("id"), F.col("conv_id").alias("doc"), body.alias("body"), F.lit(None).cast("string").alias("pinned"))
    return lifecycle.plan_supersession(existing, fresh)


SUPERSESSION = f"""
WITH stale AS (SELECT conv_id || '/' || turn AS stale, conv_id AS doc, lower({S.squeezed("text")}) AS was, CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS pin FROM conversations),
now AS (
  SELECT conv_id || '/' || turn || '/new' AS new, conv_id AS doc, lower({S.squeezed("CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN left(text, length(text) // 2) ELSE 'more ' || text END")}) AS body
  FROM conversations WHERE turn <> 4
),
matches AS (
  SELECT stale, new, CASE WHEN was = body THEN 'exact' WHEN contains(body, was) THEN 'broader' WHEN body <> '' AND contains(was, body) THEN 'piece' END AS match FROM stale JOIN now USING (doc) WHERE was <> ''
),
best AS (SELECT stale, new, match FROM matches WHERE match IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stale ORDER BY CASE WHEN match = 'exact' THEN 0 ELSE 1 END, new) = 1),
plan AS (SELECT s.stale, pin, new, match FROM stale s LEFT JOIN best b ON s.stale = b.stale),
won AS (SELECT new, min(stale) AS winner, arg_min(pin, stale) AS kept_pin FROM plan WHERE pin IS NOT NULL AND match IN ('exact', 'piece') GROUP BY new)
SELECT stale AS id, plan.new AS successor, match, pin,
  CASE WHEN pin IS NULL THEN 'superseded' WHEN plan.new IS NULL THEN 'warn_no_successor' WHEN match = 'broader' THEN 'warn_broader' WHEN stale = winner THEN 'migrated' WHEN pin = kept_pin THEN 'superseded' ELSE 'warn_conflict' END AS outcome
FROM plan LEFT JOIN won ON plan.new = won.new
"""


def captured_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' statuses as versions per customer: the captured one of the new generation is active."""
    old, new = _generations(spark, sf_dir)
    versions = old.select("o_custkey", "o_orderstatus").withColumn("is_active", F.lit(True))
    return lifecycle.capture_versions(versions, new.select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")


CAPTURED_VERSIONS = f"""
WITH {_GENERATIONS}
SELECT o.o_custkey, o.o_orderstatus, coalesce(n.o_orderstatus = o.o_orderstatus, true) AS is_active FROM old o LEFT JOIN new n USING (o_custkey)
UNION ALL SELECT n.o_custkey, n.o_orderstatus, true FROM new n LEFT JOIN old o USING (o_custkey) WHERE o.o_custkey IS NULL OR o.o_orderstatus <> n.o_orderstatus
"""


def illegal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of users' events that an edge table doesn't allow, counted."""
    legal = spark.createDataFrame(STEPS, "from_state string, to_state string")
    found = states.illegal_steps(table(spark, sf_dir, "events"), legal, ["user_id"], ["ts", "event_id"], "event_type")
    return found.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("steps"))


ILLEGAL_STEPS = f"""
WITH steps AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT from_state, to_state, count(*) AS steps FROM steps WHERE from_state <> to_state AND (from_state, to_state) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in STEPS)}) GROUP BY 1, 2
"""


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.run_log(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_type"), F.col("value") > 10)
    return rows.withColumn("day", F.col("day").cast("string"))


DAILY_LOG = """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS runs, count(*) FILTER (value > 10) AS passed, round(count(*) FILTER (value > 10) / count(*), 4) AS pass_rate FROM events GROUP BY 1, 2
"""


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags read from JSON properties, with those of absence taken away."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    flags = F.array_compact(F.array(F.when(k.isNull(), "problem_missing"), F.when(k > 50, "large"), F.when(k % 2 == 1, "odd")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.filter(flags, lambda f: ~f.isin("problem_missing", "problem_not_pain_point")), ",").alias("flags"))


EVENT_FLAGS = """
SELECT event_id, array_to_string(list_filter([CASE WHEN k > 50 THEN 'large' END, CASE WHEN k % 2 = 1 THEN 'odd' END], lambda f: f IS NOT NULL), ',') AS flags
FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def audit_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four checks of the tables against each other."""
    docs, labels, orders, lines = (table(spark, sf_dir, t) for t in ("documents", "labels", "orders", "lineitem"))
    known = labels.join(docs.select("doc_id", F.col("text").isNotNull().alias("has_text")), "doc_id", "left")
    of_order = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return audits.scorecard([
        audits.check("labels_on_documents", known, ~F.coalesce("has_text", F.lit(False)), F.col("doc_id")),
        audits.check("lines_on_orders", of_order, F.col("o_orderkey").isNull(), F.col("l_orderkey")),
        audits.check("text_lengths", docs, F.length("text") != F.col("n_chars"), F.col("doc_id")),
        audits.check("words_in_documents", docs, ~X.has_token(F.col("text")), F.col("doc_id")),
    ])


def _check_sql(name: str, rows: str, failed: str, subject: str) -> str:
    few = f"(SELECT coalesce(string_agg(s, ',' ORDER BY s), '') FROM (SELECT CAST({subject} AS VARCHAR) AS s FROM {rows} WHERE {failed} ORDER BY s LIMIT 20))"
    return f"SELECT '{name}' AS check_name, count(*) AS checked, count(*) FILTER ({failed}) AS failed, count(*) FILTER ({failed}) = 0 AS passes, {few} AS examples FROM {rows}"


AUDIT_SCORECARD = " UNION ALL ".join([
    _check_sql("labels_on_documents", "labels LEFT JOIN documents USING (doc_id)", "text IS NULL", "doc_id"),
    _check_sql("lines_on_orders", "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", "o_orderkey IS NULL", "l_orderkey"),
    _check_sql("text_lengths", "documents", "length(text) <> n_chars", "doc_id"),
    _check_sql("words_in_documents", "documents", f"len({S.tokens('text')}) = 0", "doc_id"),
])


def gate_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five audits with labels, orders and parts in the places of evidence, claims and versions."""
    docs, labels, orders, lines, part, customer = (table(spark, sf_dir, t) for t in ("documents", "labels", "orders", "lineitem", "part", "customer"))
    versions = docs.where("lang = 'en'").select(F.lit("text").alias("source"), F.col("doc_id").alias("ref"), F.col("text").alias("raw"))
    used = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("method"))
    claims = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    return audits.scorecard([
        audits.captured(labels.select(F.col("doc_id").alias("id"), F.lit("text").alias("source"), F.col("doc_id").alias("ref")), versions),
        audits.ownership_labelled(used),
        audits.reviewed_on_stale(claims, lines.select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("evidence")), part.select(F.col("p_partkey").alias("id"), (F.col("p_size") >= 10).alias("active"))),
        audits.version_consistency(part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("version")), {"part": 10}),
        audits.entity_coverage(customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, "confirmed").otherwise("proposed").alias("status")), used, orders.where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("entity"))),
    ])


GATE_AUDITS = " UNION ALL ".join([
    _check_sql("capture", "labels LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') USING (doc_id)", "coalesce(text, '') = ''", "doc_id"),
    _check_sql("ownership_labeled", "(SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IS NOT NULL) AS o", "coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '') = ''", "o_orderkey"),
    _check_sql("reviewed_on_stale", "(SELECT o_orderkey, bool_or(coalesce(p_size < 10, false)) AS stale FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1) AS o", "stale", "o_orderkey"),
    _check_sql("version_consistency", "part", "p_size IS DISTINCT FROM 10", "'part:' || p_partkey"),
    _check_sql("entity_coverage", "(SELECT * FROM customer WHERE c_acctbal >= 0) AS c", "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P') OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)", "c_custkey"),
])


def tailored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every assistant turn the user turns of its conversation that share most tokens with it, or the first three."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("conv_id").alias("group"), "role", X.token_set(F.col("text")).alias("own"))
    topics = turns.where("role = 'assistant'").select(F.col("id").alias("topic"), "group", F.col("own").alias("topic_tokens"))
    said = turns.where("role = 'user'").select(F.col("id").alias("statement"), "group", F.col("own").alias("statement_tokens"))
    return ranking.select_statements(said, topics, "topic", "statement")


TAILORED = f"""
WITH turns AS (SELECT conv_id || '/' || turn AS id, conv_id AS grp, role, list_distinct({S.tokens("text")}) AS own FROM conversations),
pairs AS (SELECT t.id AS topic, s.id AS statement, len(list_intersect(t.own, s.own)) AS overlap FROM turns t JOIN turns s ON t.grp = s.grp AND t.role = 'assistant' AND s.role = 'user'),
best AS (SELECT topic, statement, overlap, row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, statement) AS place FROM pairs WHERE overlap > 0 QUALIFY place <= 5),
rest AS (SELECT topic, statement, 0 AS overlap, row_number() OVER (PARTITION BY topic ORDER BY statement) AS place FROM pairs WHERE topic NOT IN (SELECT topic FROM best) QUALIFY place <= 3)
SELECT topic, statement, CAST(overlap AS BIGINT) AS overlap, CAST(place AS INTEGER) AS place FROM (SELECT * FROM best UNION ALL SELECT * FROM rest)
"""


def _applied() -> Column:
    """Orders as applications: their state by status and urgency."""
    urgent = F.col("o_orderpriority").startswith("1")
    return F.when(F.col("o_orderstatus") == "O", F.when(urgent, "drafted").otherwise("applied")).when(F.col("o_orderstatus") == "P", F.when(urgent, "interviewing").otherwise("ignored")).otherwise(F.when(urgent, "offer").otherwise("rejected"))


def allowed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order, as an application, may become."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _applied().alias("state"))
    steps = states.allowed(states.edges(spark, "application"))
    return orders.join(F.broadcast(steps), "state", "left").select("o_orderkey", "state", F.array_join("next_states", ",").alias("next_states"))  # six states


ALLOWED_STEPS = """
WITH o AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CASE WHEN u THEN 'drafted' ELSE 'applied' END WHEN 'P' THEN CASE WHEN u THEN 'interviewing' ELSE 'ignored' END ELSE CASE WHEN u THEN 'offer' ELSE 'rejected' END END AS state
  FROM (SELECT *, o_orderpriority LIKE '1%' AS u FROM orders)
)
SELECT o_orderkey, state, next_states FROM o JOIN (VALUES ('drafted', 'applied,ignored'), ('applied', 'interviewing,offer,rejected'), ('interviewing', 'offer,rejected'), ('rejected', ''), ('offer', ''), ('ignored', '')) AS t(state, next_states) USING (state)
"""


def story_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is chosen for each customer from orders as claims: the first problem, and actions and results once each."""
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "quantified").when(F.col("o_orderstatus") == "P", "qualitative_evidenced").otherwise("missing")
    problem = F.when(k % 3 == 0, "Orders took the whole team many hours each week").when(k % 3 == 1, "Too slow")
    claims = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("entity"), F.when(k % 7 == 0, "rejected").otherwise("approved").alias("status"), F.concat(F.lit("Sent a "), F.floor(F.col("o_totalprice") / 60000).cast("string")).alias("action"), problem.alias("problem"),
        F.when(problem.isNotNull(), "time").alias("cost_dimension"), F.lit(None).cast("string").alias("inefficiency"), F.when(kind != "missing", F.concat(F.lit("Done "), F.left("o_orderpriority", F.lit(1)))).alias("outcome"), kind.alias("result_kind"),
        stories.leverage(kind, k % 2 == 0, F.lit(False), problem).alias("leverage"), F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("flags"), (k % 4).alias("links"), F.col("o_orderdate").alias("at"),
    )
    found = stories.content(claims)
    return found.select("entity", "problem", F.array_join("problem_refs", ",").alias("problem_refs"), F.array_join("actions", ";").alias("actions"), F.array_join("results", ";").alias("results"))


STORY_CONTENT = """
WITH c AS (
  SELECT o_orderkey AS id, o_custkey AS entity, 'Sent a ' || floor(o_totalprice / 60000)::BIGINT AS action, CASE o_orderkey % 3 WHEN 0 THEN 'Orders took the whole team many hours each week' WHEN 1 THEN 'Too slow' END AS problem,
    CASE o_orderstatus WHEN 'F' THEN 'quantified' WHEN 'P' THEN 'qualitative' ELSE 'missing' END AS kind, 'Done ' || left(o_orderpriority, 1) AS outcome, o_orderkey % 5 = 0 AS flagged, o_orderkey % 4 AS links, o_orderdate AS day FROM orders WHERE o_orderkey % 7 <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN kind = 'quantified' AND id % 2 = 0 THEN 4 WHEN kind <> 'missing' THEN 3 WHEN problem IS NOT NULL THEN 2 ELSE 1 END DESC, flagged, links DESC, day DESC NULLS LAST, length(action), id) AS place FROM c
), entities AS (SELECT DISTINCT o_custkey AS entity FROM orders),
problems AS (SELECT entity, problem, array_to_string(list(id ORDER BY id), ',') AS refs FROM placed WHERE id % 3 = 0 GROUP BY 1, 2),
actions AS (SELECT entity, array_to_string(list(action ORDER BY place)[1:5], ';') AS actions FROM (SELECT entity, action, min(place) AS place FROM placed GROUP BY 1, 2) GROUP BY 1),
results AS (SELECT entity, array_to_string(list(outcome ORDER BY place), ';') AS results FROM (SELECT entity, outcome, min(place) AS place FROM placed WHERE kind <> 'missing' GROUP BY 1, 2) GROUP BY 1)
SELECT entity, problem, refs AS problem_refs, coalesce(actions, '') AS actions, coalesce(results, '') AS results FROM entities LEFT JOIN problems USING (entity) LEFT JOIN actions USING (entity) LEFT JOIN results USING (entity)
"""


def demoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per order that name a part which an earlier line has named."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    marked = stories.demoted(lines, ["l_orderkey"], "l_partkey", order)
    return marked.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if("duplicate").alias("duplicates"))


DEMOTED_LINES = "SELECT l_orderkey, count(*) AS lines, count(*) - count(DISTINCT l_partkey) AS duplicates FROM lineitem GROUP BY l_orderkey"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, orders = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders"))
    cited = dealt(lines, "l_orderkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return cited.select(F.col("l_orderkey").alias("story"), F.col("c_nationkey").alias("own"), F.col("s_nationkey").alias("space"), F.col("l_partkey").alias("id"))


def home_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's home nation: the customer's if a supplier is there, else that of most parts, ties by the greatest key."""
    return stories.home_space(_cited(spark, sf_dir))


_CITED = "cited AS (SELECT l_orderkey AS story, c_nationkey AS own, s_nationkey AS space, l_partkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
_HOMES = f"{_CITED}, homes AS (SELECT story, space AS home FROM cited GROUP BY story, space, own QUALIFY row_number() OVER (PARTITION BY story ORDER BY space = own DESC, count(DISTINCT id) DESC, space DESC) = 1)"
HOME_NATIONS = f"WITH {_HOMES} SELECT story, home FROM homes"


def foreign_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that orders cite outside their home nation, counted."""
    return stories.cross_space(_cited(spark, sf_dir)).groupBy("story").agg(F.count(F.lit(1)).alias("parts"))


FOREIGN_PARTS = f"WITH {_HOMES} SELECT story, count(DISTINCT id) AS parts FROM cited JOIN homes USING (story) WHERE space <> home GROUP BY story"


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's kinds of events in the order in which they first came."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("x"))
    return listed.select("user_id", F.array_join("x.event_type", ",").alias("kinds"))


FIRST_SEEN = "SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY user_id"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of every kind by a price table of patterns: the first pattern by name that the kind contains."""
    prices = spark.createDataFrame([("click", 0.5), ("i", 0.25), ("view", 0.1)], "pattern string, price double")
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value").cast("decimal(20,6)")), 2).cast("double").alias("units"))
    matched = kinds.join(F.broadcast(prices), F.contains("event_type", F.col("pattern")), "left")
    best = matched.groupBy("event_type", "calls", "units").agg(F.min_by("price", "pattern").alias("price"))
    return best.select("event_type", "calls", "units", F.coalesce(F.col("price"), F.lit(0.0)).alias("price"), F.round(F.col("calls") * F.coalesce("price", F.lit(0.0)), 2).alias("cost"))


COSTS = """
WITH prices(pattern, price) AS (VALUES ('click', 0.5::DOUBLE), ('i', 0.25), ('view', 0.1)),
kinds AS (SELECT event_type, count(*) AS calls, CAST(round(sum(CAST(value AS DECIMAL(20, 6))), 2) AS DOUBLE) AS units FROM events GROUP BY 1),
best AS (SELECT event_type, calls, units, coalesce(arg_min(price, pattern), 0.0) AS price FROM kinds LEFT JOIN prices ON contains(event_type, pattern) GROUP BY ALL)
SELECT event_type, calls, units, price, round(calls * price, 2) AS cost FROM best
"""


QUERIES = {
    "recent_events": (recent_events, RECENT_EVENTS), "exclusion_reasons": (exclusion_reasons, EXCLUSION_REASONS), "order_links": (order_links, ORDER_LINKS), "nested_links": (nested_links, NESTED_LINKS),
    "provenance": (provenance, PROVENANCE), "orphans": (orphans, ORPHANS), "decided_on_stale": (decided_on_stale, DECIDED_ON_STALE), "first_of_text": (first_of_text, FIRST_OF_TEXT),
    "duplicate_rate": (duplicate_rate, DUPLICATE_RATE), "slop_scorecard": (slop_scorecard, SLOP_SCORECARD), "golden_summary": (golden_summary, GOLDEN_SUMMARY),
    "decision_report": (decision_report, DECISION_REPORT), "duplicate_objects": (duplicate_objects, DUPLICATE_OBJECTS), "latest_orders": (latest_orders, LATEST_ORDERS),
    "version_numbers": (version_numbers, VERSION_NUMBERS), "leverage_ranks": (leverage_ranks, LEVERAGE_RANKS), "merged_orders": (merged_orders, MERGED_ORDERS), "inserted_orders": (inserted_orders, INSERTED_ORDERS),
    "unreviewed_replaced": (unreviewed_replaced, UNREVIEWED_REPLACED), "changed_orders": (changed_orders, CHANGED_ORDERS), "supersession": (supersession, SUPERSESSION),
    "captured_versions": (captured_versions, CAPTURED_VERSIONS), "illegal_steps": (illegal_steps, ILLEGAL_STEPS), "daily_log": (daily_log, DAILY_LOG), "event_flags": (event_flags, EVENT_FLAGS),
    "audit_scorecard": (audit_scorecard, AUDIT_SCORECARD), "gate_audits": (gate_audits, GATE_AUDITS), "tailored": (tailored, TAILORED), "allowed_steps": (allowed_steps, ALLOWED_STEPS), "story_content": (story_content, STORY_CONTENT),
    "demoted_lines": (demoted_lines, DEMOTED_LINES), "home_nations": (home_nations, HOME_NATIONS), "foreign_parts": (foreign_parts, FOREIGN_PARTS), "first_seen": (first_seen, FIRST_SEEN), "costs": (costs, COSTS),
}
