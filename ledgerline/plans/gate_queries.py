"""Queries over stored answers, the extraction gate and the gates of stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import extraction, gates
from ledgerline.plans.text_queries import EVIDENCE_CLAIMS, EVIDENCE_CODES, evidence_claims
from ledgerline.tables import shuffled, table

#: Both engines make the same answers from these pieces; @q, @m and @w stand for words of the text.
CLAIM_ANSWERS = [
    '```json\n{"claims": [{"action": "Did @q", "action_quote": "@q", "chunk_index": 0, "tools": ["a", 1, " "]}]}\n```',
    '{"claims": [{"action": "Did @q", "action_quote": "@q", "chunk_index": 0, "problem": {"text": "It was @m", "quote": "@m", "chunk_index": 0, "cost_dimension": " Time "}}]}',
    "I found this: {", '{"claims": 3}', '{"claims": [3]}', '{"claims": [{"action": " ", "action_quote": "@q", "chunk_index": 0}]}', '{"claims": [{"action": "Did @q", "chunk_index": 0}]}',
    '{"claims": [{"action": "Did", "action_quote": "@q", "chunk_index": "0"}]}', '{"claims": [{"action": "Did @q", "action_quote": "@q", "chunk_index": 99}]}',
    '{"claims": [{"action": "Did @q", "action_quote": "no such words", "chunk_index": 0}, {"action": "Also @m", "action_quote": "@m", "chunk_index": 0}]}',
    '{"claims": [{"action": "Did @q", "action_quote": "@q", "chunk_index": 0, "problem": {"text": "Bad", "quote": "no such words", "chunk_index": 0}}]}',
    '{"claims": [{"action": "Did @q", "action_quote": "@q", "chunk_index": 0, "problem": {"text": "Bad", "quote": "@q", "chunk_index": "x"}}, {"action": "Then @w", "action_quote": "@w", "chunk_index": 1}]}', '{"claims": []}',
]
RESULT_ANSWERS = [
    '{"results": [{"claim_index": 5, "chunk_index": 0, "outcome_quote": "@q", "result_text": "done", "result_kind": "qualitative_evidenced"}]}',
    '{"results": [{"claim_index": 0, "chunk_index": 0, "outcome_quote": "no such words", "result_text": "done", "result_kind": "qualitative_evidenced"}]}',
    '{"results": [{"claim_index": 0, "chunk_index": 0, "outcome_quote": "@q", "result_text": "done", "result_kind": "Quantified"}]}',
    '{"results": [{"claim_index": 0, "chunk_index": 0, "outcome_quote": "@q", "result_text": "done", "result_kind": "quantified", "metric_text": "@m"}, {"claim_index": 0, "chunk_index": 0, "outcome_quote": "@m", "result_text": "again", "result_kind": "qualitative_evidenced"}]}',
    '{"results": [{"claim_index": 0, "chunk_index": 0, "outcome_quote": "@q", "result_text": "done", "result_kind": "missing"}]}', "```\n[]\n```",
]


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of documents as chunks, and two answers on each document that quote its first words, rightly or not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = docs.select(F.col("doc_id").alias("group"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    words = docs.select("doc_id", *(F.regexp_extract("text", "([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)", k).alias(n) for k, n in enumerate(("q", "m", "v", "w"))))

    def filled(kinds: list[str], salt: int) -> DataFrame:
        form = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") * salt % len(kinds) + 1).cast("int"))
        for name in ("q", "m", "w"):
            form = F.replace(form, F.lit(f"@{name}"), F.col(name))
        return words.select(F.col("doc_id").alias("group"), form.alias("answer"))

    return chunks, filled(CLAIM_ANSWERS, 1), filled(RESULT_ANSWERS, 5)


def _sql_list(kinds: list[str]) -> str:
    return "[" + ", ".join("'" + k.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k in kinds) + "]"


_JSON = rf"""
docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)', ['q', 'm', 'v']) AS _ FROM documents),
words AS (SELECT doc_id, text, regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)', 0) AS q, regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)', 1) AS m, regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+) ([A-Za-z]+)', 3) AS w FROM docs),
raw AS (
  SELECT doc_id AS g, string_split(text, chr(10)) AS lines,
    replace(replace(replace(({_sql_list(CLAIM_ANSWERS)})[doc_id % {len(CLAIM_ANSWERS)} + 1], '@q', q), '@m', m), '@w', w) AS a, replace(replace(replace(({_sql_list(RESULT_ANSWERS)})[doc_id * 5 % {len(RESULT_ANSWERS)} + 1], '@q', q), '@m', m), '@w', w) AS b FROM words
), bare AS (SELECT g, list_transform(lines, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS lines, regexp_replace(a, '^```(json)?\n|\n```$', '', 'g') AS a, regexp_replace(b, '^```(json)?\n|\n```$', '', 'g') AS b FROM raw),
first_ AS (
  SELECT g, lines, CASE WHEN NOT json_valid(a) THEN 'not_json' WHEN json_type(a, '$.claims') IS DISTINCT FROM 'ARRAY' THEN 'no_array' END AS reason, CASE WHEN json_valid(a) AND json_type(a, '$.claims') = 'ARRAY' THEN from_json(json_extract(a, '$.claims'), '["JSON"]') ELSE []::JSON[] END AS es FROM bare
), claim_entries AS (SELECT g, lines, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS item FROM first_),
claim_bad AS (
  SELECT *, CASE WHEN json_type(e) <> 'OBJECT' THEN 'entry_not_object' WHEN json_type(e, '$.action') IS DISTINCT FROM 'VARCHAR' OR trim(e->>'action') = '' THEN 'action_missing'
    WHEN json_type(e, '$.action_quote') IS DISTINCT FROM 'VARCHAR' OR trim(e->>'action_quote') = '' THEN 'quote_missing' WHEN coalesce(json_type(e, '$.chunk_index'), '') NOT IN ('UBIGINT', 'BIGINT') THEN 'chunk_missing' END AS bad FROM claim_entries
), answer_bad AS (SELECT g, arg_min(bad, item) AS bad FROM claim_bad WHERE bad IS NOT NULL GROUP BY g),
claims_ AS (
  SELECT c.*, coalesce(contains(lines[(e->>'chunk_index')::BIGINT + 1], e->>'action_quote'), false) AS ok, json_type(e, '$.problem') IS NOT NULL AS has_problem,
    CASE WHEN json_type(e, '$.problem.chunk_index') IN ('UBIGINT', 'BIGINT') THEN coalesce(contains(lines[(e->'problem'->>'chunk_index')::BIGINT + 1], e->'problem'->>'quote'), false) ELSE false END AS problem_ok FROM claim_bad c WHERE g NOT IN (SELECT g FROM answer_bad)
), kept AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY item) - 1 AS claim_index FROM claims_ WHERE ok),
counts AS (SELECT g, count(*) AS n FROM kept GROUP BY g),
second_ AS (
  SELECT g, lines, n, CASE WHEN NOT json_valid(b) THEN 'not_json' WHEN json_type(b, '$.results') IS DISTINCT FROM 'ARRAY' THEN 'no_array' WHEN b LIKE '%"result_kind": "missing"%' THEN (CASE WHEN trim(b->'results'->0->>'outcome_quote') = '' THEN 'quote_missing' ELSE 'kind_unknown' END)
    WHEN len(json_extract(b, '$.results[*].outcome_quote')) > 0 AND list_contains(list_transform(json_extract_string(b, '$.results[*].outcome_quote'), lambda x: trim(x)), '') THEN 'quote_missing' END AS reason,
    CASE WHEN json_valid(b) AND json_type(b, '$.results') = 'ARRAY' THEN from_json(json_extract(b, '$.results'), '["JSON"]') ELSE []::JSON[] END AS es FROM bare JOIN counts USING (g)
), results_ AS (
  SELECT g, n, item, e, (e->>'claim_index')::BIGINT AS claim_index, CASE WHEN (e->>'claim_index')::BIGINT >= n THEN 'severed' WHEN NOT contains(lines[(e->>'chunk_index')::BIGINT + 1], e->>'outcome_quote') THEN 'ungrounded_outcome'
    WHEN lower(e->>'result_kind') = 'quantified' AND NOT coalesce(contains(lines[(e->>'chunk_index')::BIGINT + 1], e->>'metric_text'), false) THEN 'ungrounded_metric' END AS lost
  FROM (SELECT g, lines, n, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS item FROM second_ WHERE reason IS NULL)
), judged AS (SELECT *, CASE WHEN lost IS NULL AND row_number() OVER (PARTITION BY g, claim_index, lost IS NULL ORDER BY item) > 1 THEN 'repeated' ELSE lost END AS why FROM results_)
"""


def answer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the answers on documents was not used, and why."""
    _, ledger = extraction.grounded_drafts(*_answers(spark, sf_dir))
    return ledger.select(F.col("group").alias("doc_id"), "kind", "item", "reason")


ANSWER_LEDGER = f"""
WITH {_JSON}
SELECT g AS doc_id, 'answer' AS kind, NULL::BIGINT AS item, coalesce(reason, bad) AS reason FROM first_ LEFT JOIN answer_bad USING (g) WHERE reason IS NOT NULL OR bad IS NOT NULL
UNION ALL SELECT g, 'claim', item, 'ungrounded_action' FROM claims_ WHERE NOT ok
UNION ALL SELECT g, 'problem', item, 'ungrounded_problem' FROM kept WHERE has_problem AND NOT problem_ok
UNION ALL SELECT g, 'result_answer', NULL, reason FROM second_ WHERE reason IS NOT NULL
UNION ALL SELECT g, 'result', item, why FROM judged WHERE why IS NOT NULL
"""


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts made of the answers on documents."""
    drafts, _ = extraction.grounded_drafts(*_answers(spark, sf_dir))
    return drafts.select(F.col("group").alias("doc_id"), "claim_index", "action", F.array_join("tools", ",").alias("tools"), "problem_text", "cost_dimension", "result_kind", "result_text", "metric_text")


GROUNDED_ANSWERS = f"""
WITH {_JSON}
SELECT k.g AS doc_id, k.claim_index, trim(k.e->>'action') AS action, CASE WHEN json_type(k.e, '$.tools') = 'ARRAY' THEN 'a' ELSE '' END AS tools, CASE WHEN problem_ok THEN trim(k.e->'problem'->>'text') END AS problem_text,
  CASE WHEN problem_ok THEN lower(trim(k.e->'problem'->>'cost_dimension')) END AS cost_dimension, coalesce(lower(r.e->>'result_kind'), 'missing') AS result_kind, r.e->>'result_text' AS result_text, r.e->>'metric_text' AS metric_text
FROM kept k LEFT JOIN (SELECT * FROM judged WHERE why IS NULL) r ON r.g = k.g AND r.claim_index = k.claim_index
"""

def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims of customers, what they cite (now and then an order of another customer), and the customers' orders as chunks."""
    drafts = evidence_claims(spark, sf_dir).withColumnsRenamed({"o_custkey": "group", "o_orderkey": "place"})
    k = F.col("place")
    citations = drafts.select("group", "place", F.when(k % 2 == 0, "result").otherwise("action").alias("field"), F.lit("order").alias("source_type"), F.when(k % 17 == 0, k + 1).otherwise(k).cast("string").alias("source_ref"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.lit("order").alias("source_type"), F.col("o_orderkey").cast("string").alias("source_ref"))
    return drafts, citations, chunks


def gated_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate makes of every claim: dropped with reasons, or flags and the state of its result."""
    gated = extraction.gate(*_gated(spark, sf_dir))
    return gated.select(F.col("place").alias("o_orderkey"), F.array_join("dropped", ",").alias("dropped"), "demoted", F.array_join("flags", ",").alias("flags"), "result_status", "result_kind")


GATED_DRAFTS = f"""
WITH c AS ({EVIDENCE_CLAIMS}), cited AS (SELECT *, CASE WHEN k % 17 = 0 THEN k + 1 ELSE k END AS ref FROM c),
coded AS (
  SELECT c.*, {EVIDENCE_CODES} AS codes, CASE WHEN o.o_orderkey IS NULL THEN [CASE WHEN k % 2 = 0 THEN 'result_project_mismatch:' ELSE 'evidence_outside_project:' END || ref] ELSE []::VARCHAR[] END AS outside
  FROM cited c LEFT JOIN orders o ON o.o_orderkey = ref AND o.o_custkey = c.o_custkey
), judged AS (SELECT *, list_concat(list_filter(codes, lambda x: x IN ('problem_not_specific', 'action_fragment')), outside) AS dropped FROM coded),
kept AS (
  SELECT * EXCLUDE (dropped, codes, outside), CASE WHEN linked AND quoted <> 0 THEN (k % 10) || '/' || CASE WHEN quoted = 1 THEN 'cut' ELSE share END END AS span FROM judged WHERE len(dropped) = 0
), placed AS (SELECT *, span IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey, span ORDER BY k) > 1 AS demoted FROM kept),
stripped AS (
  SELECT * REPLACE (CASE WHEN demoted THEN 'missing' ELSE result END AS result, has_outcome AND NOT demoted AS has_outcome, linked AND NOT demoted AS linked, CASE WHEN NOT demoted THEN metric END AS metric, CASE WHEN NOT demoted THEN resolves END AS resolves) FROM placed
), flagged AS (
  SELECT o_orderkey, demoted, result, list_concat(list_filter({EVIDENCE_CODES}, lambda x: x NOT IN ('problem_missing', 'problem_not_pain_point')), CASE WHEN demoted THEN ['duplicate_outcome_span'] ELSE []::VARCHAR[] END) AS flags FROM stripped
)
SELECT o_orderkey, NULL AS dropped, demoted, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) = 0 AND result <> 'missing' THEN 'verified' ELSE 'unverified' END AS result_status, CASE result WHEN 'qualitative' THEN 'qualitative_evidenced' ELSE result END AS result_kind FROM flagged
UNION ALL SELECT o_orderkey, array_to_string(dropped, ','), false, '', NULL, CASE result WHEN 'qualitative' THEN 'qualitative_evidenced' ELSE result END FROM judged WHERE len(dropped) > 0
"""


def bounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose claims have a fault that another extraction can mend, with the number of all faults."""
    drafts, _, _ = _gated(spark, sf_dir)
    return extraction.bounced_groups(drafts).select(F.col("group").alias("o_custkey"), F.size("violations").alias("violations"))


BOUNCED = f"""
WITH c AS ({EVIDENCE_CLAIMS}), f AS (SELECT o_custkey, list_filter({EVIDENCE_CODES}, lambda x: x IS NOT NULL) AS codes FROM c)
SELECT o_custkey, sum(len(codes))::INT AS violations FROM f GROUP BY 1 HAVING bool_or(len(list_filter(codes, lambda x: x NOT IN ('problem_missing', 'problem_not_pain_point'))) > 0)
"""

def _stories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers and priorities as stories, their orders as components and claims, lines as links to parts, whose sizes are what numbers stand on."""
    orders, lines, part, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer"))
    k = F.col("o_orderkey")
    story = F.concat_ws("/", F.col("o_custkey").cast("string"), F.left("o_orderpriority", F.lit(1)))
    kind = F.when(k % 3 == 0, "action").otherwise("result")
    # of customers and parts few columns are read, so Spark takes them for much smaller than they are
    size = lines.join(shuffled(part), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min("p_size").alias("size"))
    rows = orders.join(size, k == F.col("l_orderkey"), "left")
    text = F.concat(F.lit("Sold "), F.when(k % 10 == 0, F.lit(77)).otherwise(F.coalesce("size", F.lit(77))).cast("string"), F.lit(" units"))
    cites = F.when(k % 29 == 0, F.array().cast("array<bigint>")).when(k % 13 == 0, F.array(k, k + 1)).when(k % 31 == 0, F.array(k, -k)).otherwise(F.array(k))
    quote = F.when(k % 4 > 0, F.concat(F.lit("Quote  "), F.floor(F.col("o_totalprice") / 2000).cast("string")))
    components = rows.select(story.alias("story"), F.col("o_custkey").alias("entity"), kind.alias("kind"), k.cast("int").alias("place"), k.cast("string").alias("component_id"), text.alias("text"), cites.alias("claim_ids"), F.when(kind == "result", quote).alias("outcome_quote"))
    heads = orders.groupBy(story.alias("story"), F.col("o_custkey").alias("entity")).agg(F.min("o_orderkey").alias("first"))
    said = F.when(F.col("first") % 3 == 0, "Orders took 9 days and cost the whole team").otherwise("Too slow")
    problems = heads.select("story", "entity", F.lit("problem").alias("kind"), F.lit(0).alias("place"), F.lit("problem").alias("component_id"), said.alias("text"), F.array("first").alias("claim_ids"), F.lit(None).cast("string").alias("outcome_quote"))
    claims = orders.select(k.alias("id"), F.col("o_custkey").alias("entity"), F.when(F.col("o_orderstatus") == "O", "missing").otherwise("quantified").alias("result_kind"))
    links = lines.select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("evidence"))
    evidence = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("text"))
    who = heads.join(shuffled(customer), F.col("entity") == F.col("c_custkey"))
    attested = who.where("c_acctbal < 3000").select("story", F.lit("problem").alias("kind"), F.lit("They waited").alias("text"))
    attested = attested.unionByName(who.where("c_mktsegment = 'BUILDING'").select("story", F.lit("result").alias("kind"), F.concat(F.lit("Customer "), F.col("c_mktsegment"), F.lit(" is content "), F.col("story")).alias("text")))
    return {"stories": heads.select("story", "entity"), "components": components.unionByName(problems), "claims": claims, "links": links, "evidence": evidence, "attestations": attested}


_STORIES = """
sized AS (SELECT l_orderkey, min(p_size) AS size, list(DISTINCT p_size) AS sizes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
comps AS (
  SELECT o_custkey || '/' || left(o_orderpriority, 1) AS story, o_custkey AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 'action' ELSE 'result' END AS kind, o_orderkey AS place, o_orderkey::VARCHAR AS component_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 77 ELSE coalesce(size, 77) END AS number, CASE WHEN o_orderkey % 29 = 0 THEN [] WHEN o_orderkey % 13 = 0 THEN [o_orderkey, o_orderkey + 1] WHEN o_orderkey % 31 = 0 THEN [o_orderkey, -o_orderkey] ELSE [o_orderkey] END AS claim_ids,
    CASE WHEN o_orderkey % 4 > 0 THEN 'quote ' || floor(o_totalprice / 2000)::BIGINT ELSE 'sold ' || (CASE WHEN o_orderkey % 10 = 0 THEN 77 ELSE coalesce(size, 77) END) || ' units' END AS span
  FROM orders LEFT JOIN sized ON l_orderkey = o_orderkey
), heads AS (SELECT o_custkey || '/' || left(o_orderpriority, 1) AS story, o_custkey AS entity, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
cites AS (SELECT story, entity, component_id, place, number, unnest(claim_ids) AS claim, generate_subscripts(claim_ids, 1) AS nth FROM comps),
owned AS (SELECT c.*, o.o_orderkey IS NOT NULL AS known, o.o_custkey AS owner, o.o_orderstatus, coalesce(z.sizes, []) AS sizes FROM cites c LEFT JOIN orders o ON o.o_orderkey = claim LEFT JOIN sized z ON z.l_orderkey = claim AND o.o_orderkey IS NOT NULL)
"""


def story_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults in the structure of stories, with their places."""
    s = _stories(spark, sf_dir)
    return gates.structure_faults(s["components"], s["claims"], s["links"], s["evidence"])


STORY_FAULTS = f"""
WITH {_STORIES},
grounds AS (SELECT story, component_id, flatten(list(sizes)) AS sizes FROM owned GROUP BY 1, 2),
headed AS (SELECT h.*, coalesce(z.sizes, []) AS sizes FROM heads h LEFT JOIN sized z ON l_orderkey = first),
faults AS (
  SELECT story, component_id, 'component_without_refs' AS code, NULL AS detail, 1 AS o, place, 0 AS step, 0 AS n FROM comps WHERE len(claim_ids) = 0
  UNION ALL SELECT story, component_id, CASE WHEN known THEN 'cross_entity_ref' ELSE 'orphan_component_ref' END, claim::VARCHAR, 1, place, 1, nth FROM owned WHERE NOT known OR owner <> entity
  UNION ALL SELECT story, component_id, 'unsupported_number', number::VARCHAR, 1, place, 2, 0 FROM comps LEFT JOIN grounds USING (story, component_id) WHERE NOT list_contains(coalesce(sizes, []), number)
  UNION ALL SELECT story, 'problem', 'unsupported_number', '9', 0, 0, 2, 0 FROM headed WHERE first % 3 = 0 AND NOT list_contains(sizes, 9)
  UNION ALL SELECT story, component_id, 'duplicate_outcome_span', lead, 1, place, 3, 0 FROM (SELECT *, first_value(component_id) OVER (PARTITION BY story, span ORDER BY place) AS lead FROM comps WHERE kind = 'result') WHERE lead <> component_id
)
SELECT story, CAST(row_number() OVER (PARTITION BY story ORDER BY CASE WHEN f.o = 0 THEN 0 WHEN component_id::BIGINT % 3 = 0 THEN 1 ELSE 2 END, place, component_id, step, n) AS INT) AS nth, component_id, code, detail FROM faults f
"""


def render_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stories are rendered, and why others are not."""
    s = _stories(spark, sf_dir)
    shown, loose = gates.renderable(**s)
    return gates.render_decisions(s["stories"], shown, loose)


RENDER_GATE = f"""
WITH {_STORIES},
valid AS (SELECT story, component_id, flatten(list(sizes)) AS sizes, bool_or(o_orderstatus <> 'O') AS has_result FROM owned WHERE owner = entity GROUP BY 1, 2),
standing AS (SELECT c.*, v.sizes FROM comps c JOIN valid v USING (story, component_id) WHERE kind = 'action' OR has_result),
who AS (SELECT story, entity, first, c_acctbal < 3000 AS says_problem, c_mktsegment = 'BUILDING' AS says_result FROM heads JOIN customer ON c_custkey = entity),
results AS (
  SELECT story, span FROM standing WHERE kind = 'result'
  UNION ALL SELECT story, 'customer building is content ' || story FROM who WHERE says_result AND story NOT IN (SELECT story FROM standing WHERE kind = 'result')
), loose AS (SELECT story, list_sort(list(DISTINCT number::VARCHAR)) AS numbers FROM standing WHERE NOT list_contains(sizes, number) GROUP BY 1),
judged AS (
  SELECT story, array_to_string(numbers, ',') AS numbers, concat_ws(',', CASE WHEN NOT (first % 3 = 0 OR says_problem) THEN 'problem' END, CASE WHEN story NOT IN (SELECT story FROM standing WHERE kind = 'action') THEN 'action' END, CASE WHEN story NOT IN (SELECT story FROM results) THEN 'result' END) AS lacks
  FROM who LEFT JOIN loose USING (story)
), ready AS (SELECT DISTINCT story, span FROM results JOIN judged USING (story) WHERE numbers IS NULL AND lacks = ''),
others AS (SELECT a.story, array_to_string(list_sort(list(DISTINCT b.story)), ',') AS others FROM ready a JOIN ready b ON a.span = b.span AND a.story <> b.story GROUP BY 1)
SELECT story, CASE WHEN numbers IS NOT NULL THEN 'ungrounded_number' WHEN lacks <> '' THEN 'not_ready' WHEN others IS NOT NULL THEN 'duplicate_span' ELSE 'rendered' END AS decision, CASE WHEN numbers IS NOT NULL THEN numbers WHEN lacks <> '' THEN lacks ELSE others END AS detail
FROM judged LEFT JOIN others USING (story)
"""


def decided_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories, asked to be approved or left out."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    stories = rows.select(
        k.alias("story"), F.when(k % 5 == 0, "draft").when(k % 5 == 1, "approved").otherwise("pending_review").alias("state"), F.when(k % 2 == 0, "missing").otherwise("evidenced").alias("problem_state"), (k % 3).cast("int").alias("actions"),
        F.when(k % 7 == 0, "missing").otherwise("user_attested").alias("result_state"),
    )
    asked = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "excluded")
    requests = rows.select(k.alias("story"), asked.alias("to_state"), F.col("o_orderdate").alias("at"), F.when(k % 4 == 0, " ").otherwise("why").alias("note")).where("to_state is not null")
    return gates.decide_stories(stories, requests).select("story", "state", "refused")


DECIDED_STORIES = """
WITH s AS (
  SELECT o_orderkey AS story, CASE WHEN k % 5 = 0 THEN 'draft' WHEN k % 5 = 1 THEN 'approved' ELSE 'pending_review' END AS state, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'no_problem' END, CASE WHEN k % 3 = 0 THEN 'no_action' END, CASE WHEN k % 7 = 0 THEN 'no_result' END) AS why,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'excluded' END AS asked, k % 4 = 0 AS blank FROM (SELECT *, o_orderkey AS k FROM orders)
), r AS (
  SELECT *, CASE WHEN asked IS NULL THEN NULL WHEN asked = 'approved' AND why <> '' THEN 'blocked:' || why WHEN state <> 'pending_review' THEN 'illegal' WHEN asked = 'excluded' AND blank THEN 'note_required' END AS refused FROM s
)
SELECT story, CASE WHEN asked IS NOT NULL AND refused IS NULL THEN asked ELSE state END AS state, refused FROM r
"""

QUERIES = {
    "answer_ledger": (answer_ledger, ANSWER_LEDGER), "grounded_answers": (grounded_answers, GROUNDED_ANSWERS), "gated_drafts": (gated_drafts, GATED_DRAFTS), "bounced": (bounced, BOUNCED),
    "story_faults": (story_faults, STORY_FAULTS), "render_gate": (render_gate, RENDER_GATE), "decided_stories": (decided_stories, DECIDED_STORIES),
}
