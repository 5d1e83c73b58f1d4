"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import lexicon as L
from ledgerline.functions import text as X
from ledgerline.operators import entities, graph, ranking, segments, statements, structure
from ledgerline.plans import sqltext as S
from ledgerline.sources import scan
from ledgerline.tables import table


def top_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings (their first line is the title) against the benchmark as a profile."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    profile = ranking.profile_tokens(table(spark, sf_dir, "benchmark"))
    scored = ranking.score_postings(docs, profile, F.col("title"), F.col("text"))
    best = ranking.rank(ranking.shortlist(scored, "doc_id"), "doc_id")
    return best.select("doc_id", "score", "rank", F.array_join(F.slice("matched_terms", 1, 8), ",").alias("terms"))


TOP_POSTINGS = f"""
WITH profile AS (SELECT list_distinct(flatten(list({S.tokens("text")}))) AS own FROM benchmark),
docs AS (SELECT doc_id, list_distinct({S.tokens("string_split(text, chr(10))[1]")}) AS title, list_distinct({S.tokens("string_split(text, chr(10))[1] || ' ' || text")}) AS job FROM documents),
scored AS (
  SELECT doc_id, list_sort(list_intersect(job, own)) AS terms,
    CASE WHEN len(job) = 0 THEN 0.0 ELSE least(1.0, round(len(list_intersect(job, own)) / len(job) + 0.1 * len(list_intersect(title, own)), 4)) END AS score
  FROM docs, profile
)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, array_to_string(terms[1:8], ',') AS terms
FROM scored ORDER BY score DESC, doc_id LIMIT 10
"""


def posting_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    profile = ranking.profile_tokens(table(spark, sf_dir, "benchmark"))
    return ranking.score_postings(docs, profile, F.col("title"), F.col("text")).select("doc_id", "score", F.size("matched_terms").alias("matched"))


POSTING_SCORES = TOP_POSTINGS.split("SELECT doc_id, CAST(score")[0] + "SELECT doc_id, CAST(score AS DOUBLE) AS score, CAST(len(terms) AS INTEGER) AS matched FROM scored"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


TOKEN_COUNTS = f"SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)"


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest tokens of every language."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(X.tokens(F.col("text"))).alias("term"))
    counted = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("times"), "term"))
    return counted.withColumn("place", place).where("place <= 5")


TOP_TERMS = f"""
SELECT lang, term, times, CAST(place AS INTEGER) AS place FROM (
  SELECT lang, term, count(*) AS times, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS place
  FROM (SELECT lang, unnest({S.tokens("text")}) AS term FROM documents) GROUP BY lang, term
) WHERE place <= 5
"""


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source are ok, unreadable or left out by a policy on languages."""
    docs = table(spark, sf_dir, "documents")
    why = scan.drive_exclusion(F.col("lang"), F.col("source"), ["en", "de", "fr"], None, broad=True)
    return docs.groupBy("source", scan.disposition(why, F.col("text")).alias("status"), why.alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


DISPOSITIONS = f"""
SELECT source, CASE WHEN reason IS NOT NULL THEN 'policy_excluded' WHEN text IS NULL OR {S.matches("text", L.READ_FAILED)} THEN 'read_failed' ELSE 'ok' END AS status, reason, count(*) AS documents
FROM (SELECT *, CASE WHEN coalesce(lang IN ('en', 'de', 'fr'), false) THEN NULL ELSE 'mime_not_allowed:' || coalesce(lang, '') END AS reason FROM documents) GROUP BY ALL
"""


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


CANONICAL_URLS = f"""
WITH parts AS (
  SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS host, regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path,
    list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({", ".join(map(S.quoted, L.TRACKING))}) AND NOT starts_with(lower(p), 'utm_')) AS kept
  FROM (SELECT page_id, regexp_replace(trim(url, ' '), '#.*$', '') AS u FROM pages)
)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM parts
"""


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.sha2(text, 256).alias("text_sha256"))


# fixed values: references in pages; those without a semicolon are undone too, after those with one
_REFERENCES = [("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "chr(1)"), ("&amp", "chr(1)")]
_UNDONE = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _reference, _char in _REFERENCES:
    _UNDONE = f"replace({_UNDONE}, '{_reference}', {_char})"
HTML_TEXTS = f"""
SELECT page_id, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS text_sha256 FROM (SELECT page_id, {S.squeezed(f"replace({_UNDONE}, chr(1), '&')")} AS t FROM pages)
"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("content_hash"), X.short_id("doc", F.col("text")).alias("component_id"), F.concat_ws(":", "doc_id", F.sha2("text", 256), F.lit(segments.VERSION)).alias("ledger_key"))


FINGERPRINTS = f"""
SELECT doc_id, sha256(text) AS content_hash, 'doc-' || left(sha256(lower({S.squeezed("text")})), 12) AS component_id, doc_id || ':' || sha256(text) || ':{segments.VERSION}' AS ledger_key FROM documents
"""


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.compact_key(F.col("c_name")).alias("compact"), X.loose_key(F.col("c_name")).alias("loose"))


_LOOSE = S.squeezed("regexp_replace(c_name, '[-_/.]+', ' ', 'g')")
NAME_KEYS = f"SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS compact, lower({_LOOSE}) AS loose FROM customer"


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements.split_statements(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("statements"), F.sum(F.length("statement")).alias("chars"))


SENTENCE_COUNTS = f"SELECT doc_id, count(*) AS statements, sum(length(statement))::BIGINT AS chars FROM ({S.statements('documents', 'doc_id', 'text')}) WHERE statement <> '' GROUP BY doc_id"


def statement_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of conversations by role and kind of result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    turns = turns.select(F.concat_ws("/", "conv_id", "turn").alias("chunk"), "text")
    rows = statements.with_roles(statements.split_statements(turns, "chunk", "text"))
    return rows.groupBy("role", "result_type", "cost_dimension", "inefficiency").agg(F.count(F.lit(1)).alias("statements"))


STATEMENT_ROLES = f"""
WITH turns AS (SELECT conv_id || '/' || turn AS chunk, text FROM conversations),
rows AS ({S.statements("turns", "chunk", "text")})
SELECT {S.role("statement")} AS role, {S.result_type("statement")} AS result_type, {S.first_tag("statement", L.COSTS)} AS cost_dimension, {S.first_tag("statement", L.INEFFICIENCIES)} AS inefficiency, count(*) AS statements
FROM rows WHERE statement <> '' GROUP BY ALL
"""


def problem_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn of a conversation the last user turn above it."""
    rows = statements.forward_fill(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "context_turn")
    return rows.select("conv_id", "turn", "role", F.coalesce("context_turn", F.lit(-1)).alias("context_turn"))


PROBLEM_CONTEXT = """
SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS context_turn FROM conversations
"""


def invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that have any of a few phrases, none of some others, and their first line that has one."""
    wanted, refused = ["tion", "est"], ["worthless", "idiot"]
    low = F.lower("text")
    line = F.get(F.filter(F.split("text", "\n"), lambda x: X.any_of(F.lower(x), wanted) & (F.trim(x) != "")), F.lit(0))
    rows = table(spark, sf_dir, "conversations").where(X.any_of(low, wanted) & ~X.any_of(low, refused)).withColumn("quote", F.trim(line)).where("quote is not null")
    return rows.select("conv_id", "turn", F.sha2("quote", 256).alias("quote_sha256"), X.verbatim_in(F.col("quote"), F.col("text")).alias("verified"))


INVITATIONS = f"""
SELECT conv_id, turn, sha256(quote) AS quote_sha256, contains({S.squeezed("text")}, {S.squeezed("quote")}) AS verified FROM (
  SELECT *, trim(list_filter(string_split(text, chr(10)), lambda x: {S.any_of("lower(x)", ["tion", "est"])} AND trim(x, ' ') <> '')[1], ' ') AS quote FROM conversations
  WHERE {S.any_of("lower(text)", ["tion", "est"])} AND NOT {S.any_of("lower(text)", ["worthless", "idiot"])}
) WHERE quote IS NOT NULL
"""


def number_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number tokens of each turn that the turn before doesn't have."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.number_tokens(F.col("text")).alias("own"))
    turns = turns.withColumn("before", F.lag("own").over(W.partitionBy("conv_id").orderBy("turn")))
    loose = F.array_sort(F.array_except("own", F.coalesce("before", F.array().cast("array<string>"))))
    return turns.select("conv_id", "turn", F.array_join(loose, ",").alias("unsupported"))


_SQL_DIGITS = r"\$?\d[\d,]*(?:\.\d+)?(?:[KkMmBb]\b)?%?"
NUMBER_GATE = f"""
WITH own AS (
  SELECT conv_id, turn, list_distinct(list_concat(list_transform(regexp_extract_all(text, {S.quoted(_SQL_DIGITS)}), lambda t: replace(t, ',', '')),
    list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains({S.array(L.NUMBER_WORDS)}, w)))) AS own FROM conversations
),
pairs AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM own)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(own, lambda t: NOT list_contains(before, t))), ',') AS unsupported FROM pairs
"""


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources by the number of distinct lines of 60 characters or more that they share."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return entities.entity_overlaps(lines, "source", "line")


SHARED_LINES = f"""
WITH lines AS (SELECT DISTINCT source, lower({S.squeezed("line")}) AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length({S.squeezed("line")}) >= 60)
SELECT a.source AS entity_a, b.source AS entity_b, count(*) AS shared FROM lines a JOIN lines b ON a.line = b.line AND a.source < b.source GROUP BY ALL
"""


def assigned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's one language of most shared tokens; null on ties."""
    items = table(spark, sf_dir, "benchmark").select("item_id", X.token_set(F.col("text")).alias("own"))
    return entities.assign(items, entities.profile_of(table(spark, sf_dir, "documents"), "lang", "text"), "item_id", "own")


ASSIGNED_ITEMS = f"""
WITH profiles AS (SELECT DISTINCT lang, unnest({S.tokens("text")}) AS token FROM documents),
items AS (SELECT DISTINCT item_id, unnest({S.tokens("text")}) AS token FROM benchmark),
shared AS (SELECT item_id, lang, count(*) AS overlap FROM items JOIN profiles USING (token) GROUP BY ALL),
top AS (SELECT item_id, max(overlap) AS most FROM shared GROUP BY item_id),
best AS (SELECT item_id, most, CASE WHEN count(*) = 1 THEN max(lang) END AS entity FROM shared JOIN top USING (item_id) WHERE overlap = most GROUP BY item_id, most)
SELECT item_id, entity, coalesce(most, 0) AS overlap FROM benchmark LEFT JOIN best USING (item_id)
"""


def item_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents word for word."""
    return entities.mentions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


ITEM_MENTIONS = "SELECT DISTINCT doc_id AS document, item_id AS term FROM documents JOIN benchmark ON contains(documents.text, benchmark.text) WHERE trim(replace(benchmark.text, chr(10), ' ')) <> ''"


def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names, the fourth word of every benchmark item and its second and third, as exact substrings of documents."""
    items = table(spark, sf_dir, "benchmark").withColumn("words", F.split("text", " "))
    names = items.select("item_id", F.array_join(F.slice("words", 2, 2), " ").alias("name"))
    names = names.unionByName(items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.get("words", F.lit(3)).alias("name")))
    return entities.mentions(table(spark, sf_dir, "documents"), names, "doc_id", "text", "item_id", "name")


NAME_MENTIONS = """
WITH names AS (
  SELECT item_id, array_to_string(string_split(text, ' ')[2:3], ' ') AS name FROM benchmark
  UNION ALL SELECT item_id + 1000000, string_split(text, ' ')[4] FROM benchmark
)
SELECT DISTINCT doc_id AS document, item_id AS term FROM documents JOIN names ON contains(text, name) WHERE trim(name) <> ''
"""


def _item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.token_set(F.col("text")).alias("own"))


def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.similar_pairs(_item_sets(spark, sf_dir), "item_id", "own", 0.1)


_SIMILAR = f"""
sets AS (SELECT item_id, list_distinct({S.tokens("text")}) AS own FROM benchmark),
pairs AS (
  SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.own, y.own)) AS shared, len(x.own) + len(y.own) - len(list_intersect(x.own, y.own)) AS either
  FROM sets x JOIN sets y ON x.item_id < y.item_id WHERE len(list_intersect(x.own, y.own)) > 0
)
"""
SIMILAR_ITEMS = f"WITH {_SIMILAR} SELECT a, b, round(shared / either, 6) AS similarity FROM pairs WHERE shared >= 0.1 * either"


def item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive groups of similar items."""
    sets = _item_sets(spark, sf_dir)
    parts = graph.connected_components(entities.similar_pairs(sets, "item_id", "own", 0.1))
    return sets.join(parts, F.col("item_id") == F.col("node"), "left").select("item_id", F.coalesce("component", "item_id").alias("group_id"))


ITEM_GROUPS = f"""
WITH RECURSIVE {_SIMILAR},
links AS (SELECT a, b FROM pairs WHERE shared >= 0.1 * either UNION SELECT b, a FROM pairs WHERE shared >= 0.1 * either),
reached AS (SELECT item_id AS node, item_id AS other FROM benchmark UNION SELECT node, b FROM reached JOIN links ON other = a)
SELECT node AS item_id, min(other) AS group_id FROM reached GROUP BY node
"""


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "paragraph", "start", "end", F.sha2("body", 256).alias("body_sha256"))


PARAGRAPH_SPANS = """
WITH blocks AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS paragraph FROM documents),
placed AS (SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, chr(10))) AS start, trim(raw, chr(10)) AS body FROM blocks)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(start AS BIGINT) AS start, CAST(start + length(body) AS BIGINT) AS "end", sha256(body) AS body_sha256 FROM placed WHERE body <> ''
"""


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "start", "end", F.sha2("body", 256).alias("body_sha256"))


#: Paragraphs between blank lines, cut again and again at the last newline, else the last space, else hard.
CHUNK_SPANS = """
WITH RECURSIVE blocks AS (
  SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS block FROM documents
),
placed AS (SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks),
paragraphs AS (
  SELECT doc_id, CAST(before + length(raw) - length(ltrim(raw, chr(10))) AS INTEGER) AS start, trim(raw, chr(10)) AS body FROM placed WHERE trim(raw, chr(10)) <> ''
),
cuts AS (
  SELECT doc_id, start, body AS rest, CAST(NULL AS VARCHAR) AS piece, 0 AS pos, CAST(0 AS BIGINT) AS size FROM paragraphs
  UNION ALL
  SELECT doc_id, start, ltrim(substr(rest, cut + 1), chr(10) || ' '), left(rest, cut), CAST(next_pos AS INTEGER), CAST(length(rest) - length(ltrim(substr(rest, cut + 1), chr(10) || ' ')) AS BIGINT)
  FROM (
    SELECT *, pos + size AS next_pos, CASE
      WHEN length(rest) <= 1200 THEN length(rest)
      WHEN strpos(reverse(substr(rest, 2, 1199)), chr(10)) > 0 THEN 1200 - strpos(reverse(substr(rest, 2, 1199)), chr(10))
      WHEN strpos(reverse(substr(rest, 2, 1199)), ' ') > 0 THEN 1200 - strpos(reverse(substr(rest, 2, 1199)), ' ')
      ELSE 1200 END AS cut
    FROM cuts WHERE rest <> ''
  )
)
SELECT doc_id, CAST(start + pos AS INTEGER) AS start, CAST(start + pos + length(piece) AS INTEGER) AS "end", sha256(piece) AS body_sha256 FROM cuts WHERE piece IS NOT NULL
"""


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the chunks of all documents: none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segments.coverage_violations(docs, segments.chunked(docs, "doc_id"), "doc_id")


CHUNK_COVERAGE = "SELECT doc_id, 0::BIGINT AS start, ''::VARCHAR AS reason FROM documents WHERE false"


def reflowed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.reflowed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.length("normal_text").alias("chars"), F.sha2("normal_text", 256).alias("text_sha256"))


#: Notes that orders have by number.
NOTES = [
    "Problem: Reports took the whole team many hours each week\nAction: Built a nightly loader in Python for all reports\nResult: Reduced report time by 45%",
    "Action: Built a nightly loader in Python for all reports\nProblem: Reports took the whole team many hours each week",
    "- Built a nightly loader in Python for all reports\n- Deployed it with Docker on every machine we have\n- Reduced report time by 45%",
    "# Notes\nThe reports were slow.\nAction: Moved data to", "Result: Reduced report time by 45%\nNothing else here",
    "Problem: Manual spreadsheets\nAction: Automated the weekly report in Python and SQL\nResult: Eliminated manual spreadsheets",
]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("o_orderkey") % len(NOTES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("chunk"), note.alias("text"))


def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims assembled from notes on orders and what is wrong with them."""
    claims = statements.claim_violations(statements.extract_claims(_notes(spark, sf_dir), "o_orderkey", "chunk", "text"))
    return claims.select("o_orderkey", "position", F.left("action", F.lit(12)).alias("action"), "result_kind", "resolves", F.array_join("tools", ",").alias("tools"), F.array_join("violations", ",").alias("violations"))


# what the rules give for each note: a problem holds for later work only, outcomes go to works in turn, and without a work they are left over
CLAIM_FLAGS = f"""
SELECT o_orderkey, position, action, result_kind, resolves, tools, violations FROM orders JOIN (VALUES
  (0, 1, 'Built a nigh', 'quantified', 'time', 'Python', ''), (1, 0, 'Built a nigh', 'missing', NULL, 'Python', 'problem_missing'), (2, 0, 'Built a nigh', 'quantified', 'time', 'Python', 'problem_missing,result_problem_coupling'),
  (2, 1, 'Deployed it ', 'missing', NULL, 'Docker', 'problem_missing'), (3, 1, 'Moved data t', 'missing', NULL, '', 'problem_not_specific,action_names_no_tools,action_fragment'),
  (5, 1, 'Automated th', 'qualitative_evidenced', 'manual', 'Python,SQL', 'problem_not_specific')
) AS c(note, position, action, result_kind, resolves, tools, violations) ON o_orderkey % {len(NOTES)} = note
"""


def note_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of notes on orders by what they are."""
    rows = statements.with_roles(statements.split_statements(_notes(spark, sf_dir), "chunk", "text"))
    return rows.select(F.col("chunk").alias("o_orderkey"), "position", "label", "role", "result_type", "cost_dimension", "inefficiency")


NOTE_ROLES = f"""
SELECT o_orderkey, position, label, role, result_type, cost_dimension, inefficiency FROM orders JOIN (VALUES
  (0, 0, 'problem', 'problem', NULL, 'time', 'slow'), (0, 1, 'action', 'work', NULL, NULL, NULL), (0, 2, 'result', 'outcome', 'quantitative', 'time', NULL), (1, 0, 'action', 'work', NULL, NULL, NULL), (1, 1, 'problem', 'problem', NULL, 'time', 'slow'),
  (2, 0, NULL, 'work', NULL, NULL, NULL), (2, 1, NULL, 'work', NULL, NULL, NULL), (2, 2, NULL, 'outcome', 'quantitative', 'time', NULL), (3, 0, NULL, 'problem', NULL, NULL, 'slow'), (3, 1, 'action', 'work', NULL, NULL, NULL),
  (4, 0, 'result', 'outcome', 'quantitative', 'time', NULL), (4, 1, NULL, 'ignored', NULL, NULL, NULL), (5, 0, 'problem', 'problem', NULL, NULL, 'manual'), (5, 1, 'action', 'work', NULL, 'time', NULL), (5, 2, 'result', 'outcome', 'automation', NULL, 'manual')
) AS c(note, position, label, role, result_type, cost_dimension, inefficiency) ON o_orderkey % {len(NOTES)} = note
"""


def evidence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made from order keys, with every fault that evidence can have."""
    k = F.col("o_orderkey")
    share = F.concat((k % 90).cast("string"), F.lit("%"))
    said = F.concat(F.lit("Reduced load time by "), share)
    quote = F.when(k % 9 == 0, " ").when(k % 9 == 1, "Cut load time").otherwise(said)
    links = F.array(F.struct(F.concat(F.lit("note:"), (k % 10).cast("string")).alias("source_ref"), quote.alias("outcome_quote"), F.concat(F.lit("notes:  Reduced load  time by "), share).alias("chunk_text")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(k % 5 == 0, "").when(k % 5 == 1, "Moved data to").otherwise("Built the nightly loader in Python for all files").alias("action"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "It was slow").otherwise("Reports were slow and took the whole team many days").alias("problem"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("Go"))).otherwise(F.array(F.lit("Python"))).alias("tools"),
        F.when(k % 2 == 0, "time").alias("cost_dimension"), F.when(k % 6 == 0, "slow").alias("inefficiency"),
        F.when(k % 11 == 0, "missing").when(k % 11 < 6, "quantified").otherwise("qualitative_evidenced").alias("result_kind"),
        F.when((k % 11 == 0) & (k % 2 == 0), None).when(k % 13 == 0, "").otherwise(said).alias("outcome"),
        F.when((k % 8 == 0) | ((k % 11 == 0) & (k % 4 == 2)), F.slice(links, 1, 0)).otherwise(links).alias("result_links"),
        F.when((k % 10 == 0) | (k % 11 == 0), None).when(k % 10 == 1, "no such text").otherwise(share).alias("metric_text"),
        F.when(k % 5 < 3, "time").when(k % 5 == 3, "slow").alias("resolves"),
    )


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of what is wrong with each of these claims."""
    return statements.claim_violations(evidence_claims(spark, sf_dir)).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


EVIDENCE_CLAIMS = """
  SELECT o_orderkey, o_custkey, o_orderkey AS k, (o_orderkey % 90) || '%' AS share,
    CASE WHEN k % 5 = 0 THEN 'none' WHEN k % 5 = 1 THEN 'short' ELSE 'long' END AS action,
    CASE WHEN k % 4 = 0 THEN 'none' WHEN k % 4 = 1 THEN 'short' ELSE 'long' END AS problem,
    CASE WHEN k % 3 = 0 THEN 'none' WHEN k % 7 = 0 THEN 'Go' ELSE 'Python' END AS tool,
    CASE WHEN k % 2 = 0 THEN 'time' END AS cost, CASE WHEN k % 6 = 0 THEN 'slow' END AS waste,
    CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 11 < 6 THEN 'quantified' ELSE 'qualitative' END AS result,
    NOT ((k % 11 = 0 AND k % 2 = 0) OR k % 13 = 0) AS has_outcome, NOT (k % 8 = 0 OR (k % 11 = 0 AND k % 4 = 2)) AS linked,
    CASE WHEN k % 10 = 0 OR k % 11 = 0 THEN NULL WHEN k % 10 = 1 THEN 'no such text' ELSE share END AS metric,
    CASE WHEN k % 5 < 3 THEN 'time' WHEN k % 5 = 3 THEN 'slow' END AS resolves, k % 9 AS quoted
  FROM orders
"""

EVIDENCE_CODES = """[
  CASE WHEN problem = 'none' THEN 'problem_missing' END,
  CASE WHEN problem <> 'none' AND cost IS NULL AND waste IS NULL THEN 'problem_not_pain_point' END,
  CASE WHEN problem = 'short' THEN 'problem_not_specific' END,
  CASE WHEN action = 'none' THEN 'action_missing' END,
  CASE WHEN action <> 'none' AND tool = 'none' THEN 'action_names_no_tools' END,
  CASE WHEN action <> 'none' AND (tool = 'Go' OR (tool = 'Python' AND action = 'short')) THEN 'action_tool_not_in_text' END,
  CASE WHEN action = 'short' THEN 'action_fragment' END,
  CASE WHEN result = 'missing' AND (has_outcome OR linked) THEN 'missing_result_filled' END,
  CASE WHEN result <> 'missing' AND NOT has_outcome THEN 'result_text_missing' END,
  CASE WHEN result <> 'missing' AND NOT linked THEN 'result_evidence_missing' END,
  CASE WHEN result <> 'missing' AND linked AND quoted = 0 THEN 'outcome_quote_missing' END,
  CASE WHEN result <> 'missing' AND linked AND quoted = 1 THEN 'outcome_quote_not_verbatim' END,
  CASE WHEN result = 'quantified' AND metric IS NULL THEN 'result_metric_json_missing' END,
  CASE WHEN result = 'quantified' AND metric IS NOT NULL AND (metric = 'no such text' OR NOT linked) THEN 'result_metric_not_verbatim' END,
  CASE WHEN result <> 'missing' AND (resolves IS NULL OR (resolves IS DISTINCT FROM cost AND resolves IS DISTINCT FROM waste)) THEN 'result_problem_coupling' END
]"""

EVIDENCE_FLAGS = f"WITH c AS ({EVIDENCE_CLAIMS}) SELECT o_orderkey, coalesce(array_to_string({EVIDENCE_CODES}, ','), '') AS violations FROM c"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in batches of at most 30 and 14,000 characters."""
    return segments.packed_batches(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars")


BATCHES = """
WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (
  SELECT source, doc_id, i, 0 AS batch, 1 AS held, n_chars AS total FROM r WHERE i = 1
  UNION ALL
  SELECT r.source, r.doc_id, r.i, g.batch + CASE WHEN held + 1 > 30 OR total + n_chars > 14000 THEN 1 ELSE 0 END,
    CASE WHEN held + 1 > 30 OR total + n_chars > 14000 THEN 1 ELSE held + 1 END, CASE WHEN held + 1 > 30 OR total + n_chars > 14000 THEN n_chars ELSE total + n_chars END
  FROM g JOIN r ON r.source = g.source AND r.i = g.i + 1
)
SELECT source, doc_id, CAST(batch AS INTEGER) AS batch FROM g
"""


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of every document by kind."""
    return structure.elements(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("elements"), F.sum(F.length("body")).alias("chars"))


def element_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents that no element has: none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segments.coverage_violations(docs, structure.elements(docs, "doc_id").select("doc_id", "start", "end", "body"), "doc_id")


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest per language over its documents in order, by way of a digest for each."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("d"))
    return docs.groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "d"))), lambda x: x["d"]), ","), 256).alias("digest"))


CORPUS_DIGEST = "SELECT lang, doc_id // 1000 AS block, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2"


QUERIES = {
    "top_postings": (top_postings, TOP_POSTINGS), "posting_scores": (posting_scores, POSTING_SCORES), "token_counts": (token_counts, TOKEN_COUNTS), "top_terms": (top_terms, TOP_TERMS),
    "dispositions": (dispositions, DISPOSITIONS), "canonical_urls": (canonical_urls, CANONICAL_URLS), "html_texts": (html_texts, HTML_TEXTS), "fingerprints": (fingerprints, FINGERPRINTS),
    "name_keys": (name_keys, NAME_KEYS), "sentence_counts": (sentence_counts, SENTENCE_COUNTS), "statement_roles": (statement_roles, STATEMENT_ROLES),
    "problem_context": (problem_context, PROBLEM_CONTEXT), "invitations": (invitations, INVITATIONS), "number_gate": (number_gate, NUMBER_GATE), "shared_lines": (shared_lines, SHARED_LINES),
    "assigned_items": (assigned_items, ASSIGNED_ITEMS), "item_mentions": (item_mentions, ITEM_MENTIONS), "name_mentions": (name_mentions, NAME_MENTIONS), "similar_items": (similar_items, SIMILAR_ITEMS), "item_groups": (item_groups, ITEM_GROUPS),
    "paragraph_spans": (paragraph_spans, PARAGRAPH_SPANS), "chunk_spans": (chunk_spans, CHUNK_SPANS), "chunk_coverage": (chunk_coverage, CHUNK_COVERAGE), "reflowed_texts": (reflowed_texts, None),
    "claim_flags": (claim_flags, CLAIM_FLAGS), "note_roles": (note_roles, NOTE_ROLES), "evidence_flags": (evidence_flags, EVIDENCE_FLAGS), "batches": (batches, BATCHES), "page_elements": (page_elements, None), "element_coverage": (element_coverage, CHUNK_COVERAGE), "corpus_digest": (corpus_digest, CORPUS_DIGEST),
}
