"""URL filter: prefix rules first, then an empirical-Bayes reputation of the host.

A host's share of good pages is a beta-binomial posterior whose prior comes from
its registered domain, whose own prior comes from its suffix, and that from all
pages. The strength of each prior is fitted by moments: the more the children of
a parent differ beyond chance, the weaker it is. A page without a rule is blocked
when even the upper bound of its host's posterior lies below the threshold, which
is a fixed share or the share of good pages over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, materialize, split_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Country suffixes under which names are registered at the third level.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
GOOD_SHARE, WIDTH = 0.5, 1.645
STRONGEST, WEAKEST = 1e6, 1.0
#: Up to so many rules are broadcast; more are joined by shuffling.
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two for country suffixes such as ``co.uk``."""
    labels = F.split(host, "[.]")
    second = F.get(labels, F.size(labels) - 2)
    wide = (F.length(F.get(labels, F.size(labels) - 1)) == 2) & second.isin(SECOND_LEVEL) & (F.size(labels) > 2)
    return F.when(wide, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    suffix = suffix_of(host)
    return F.when(F.size(F.split(suffix, "[.]")) == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for those distinct (host, path) that a rule fits: of several the longest host, then the longest path.

    ``rules`` has verdict, host and path, all set; of rules with equal host and path the first verdict in order counts.
    """
    rules = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("verdict"))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    sized = F.broadcast if small else (lambda x: x)
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    asked = places.select("host", "path", F.explode(tails).alias("rule_host")).join(sized(lengths), "rule_host")
    asked = asked.select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    asked = asked.withColumn("rule_path", F.left(F.col("path"), F.col("n")))
    found = asked.join(sized(rules), ["rule_host", "rule_path"])
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule_host"), F.length("rule_path"), "rule_host", "rule_path", "verdict")).alias("best"))
    return best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.verdict").alias("verdict"))


def _strength(children: DataFrame, strongest: float) -> float:
    """Pseudo-counts of a beta prior by moments, from rows (good, n, prior): as strong as allowed if children differ no more than by chance."""
    z = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior")))
    excess, freedom = children.where("n > 0 and prior > 0 and prior < 1").agg(F.sum(z - 1), F.sum(F.col("n") - 1)).first()
    if not excess or excess <= 0 or not freedom:
        return strongest
    return float(min(strongest, max(WEAKEST, freedom / excess - 1)))


def overall_share(good: float | None, n: float | None) -> float:
    """The share of good pages over all, a half without any."""
    return ((good or 0.0) + 0.5) / ((n or 0.0) + 1)


def host_reputation(outcomes: DataFrame, hosts: DataFrame, width: float = WIDTH, strongest: float = STRONGEST) -> DataFrame:
    """(host, labelled, share, upper, overall): posterior mean and upper bound of the share of good pages for every row of ``hosts`` (distinct host).

    ``outcomes`` has host and good (0 or 1); ``labelled`` is their number. Hosts
    without outcomes get their domain's prior, and so on up; without any outcome
    the share is a half. ``upper`` lies ``width`` deviations above the mean, a
    prior counts for ``strongest`` pages at most, and ``overall`` is the share of all outcomes.
    """
    counted = outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("good"), F.count("good").cast("double").alias("n"))
    by_host = hosts.select("host", F.lit(True).alias("wanted")).join(counted, "host", "full").fillna(0.0, ["good", "n"])
    by_host = materialize(by_host.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")))
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    by_domain = materialize(by_host.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("hosts")))
    by_suffix = materialize(by_domain.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("domains")))
    top = overall_share(*by_suffix.agg(*sums).first())

    def shrunk(rows: DataFrame) -> Column:
        strength = _strength(rows, strongest)
        return (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)

    level = by_suffix.withColumn("prior", F.lit(top))
    suffixes = materialize(level.select("suffix", "domains", shrunk(level).alias("prior")))
    level = materialize(split_join(by_domain, suffixes, ["suffix"], "domains"))
    domains = materialize(level.select("domain", "hosts", shrunk(level).alias("prior")))
    level = materialize(split_join(by_host, domains, ["domain"], "hosts"))
    size = F.col("n") + _strength(level, strongest)
    share = (F.col("good") + (size - F.col("n")) * F.col("prior")) / size
    upper = share + width * F.sqrt(share * (1 - share) / (size + 1))
    return level.where("wanted").select("host", F.col("n").cast("long").alias("labelled"), share.alias("share"), upper.alias("upper"), F.lit(top).alias("overall"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, outcomes: DataFrame, url_col: str = "url", good_share: float | None = GOOD_SHARE, width: float = WIDTH, strongest: float = STRONGEST
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, share, upper and labelled (underscores appended to names already taken).

    ``rules`` has verdict (allow or block), host and path; a rule fits its host
    and all subdomains if the path starts with the rule's, and the longest wins.
    ``outcomes`` has host and good (0 or 1) per labelled page. Pages without a
    rule are blocked if the upper bound of their host's share of good pages is
    below ``good_share``, or where that is None below the share of all outcomes.
    ``share`` and ``upper`` are the host's, ``labelled`` its number of outcomes;
    for ``width`` and ``strongest`` see host_reputation. A null url, or one
    without ``://``, has an empty host and path and is judged as a host of that
    name. All rows stay, repeated ones too; an empty table gives an empty one.
    """
    added = [fresh(pages, c) for c in ("host", "path", "rule", "verdict", "share", "upper", "labelled")]
    host, path = added[:2]
    rows = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    places = materialize(rows.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("pages")))
    hosts = materialize(places.groupBy("host").agg(F.count(F.lit(1)).alias("places")))
    known = host_reputation(outcomes, hosts, width, strongest)
    known = materialize(known.join(hosts, "host"))  # both have a host once
    judged = split_join(places, known, ["host"], "places").join(match_rules(places, rules), ["host", "path"], "left")
    bound = F.col("overall") if good_share is None else F.lit(good_share)
    verdict = F.coalesce("verdict", F.when(F.col("upper") < bound, F.lit("block")).otherwise(F.lit("allow")))
    count = fresh(pages, "pages", *added)
    judged = materialize(judged.select("host", "path", "rule", verdict.alias("verdict"), "share", "upper", "labelled", "pages").toDF(*added, count))
    return split_join(rows, judged, [host, path], count).select(*(F.col(f"`{c}`") for c in (*pages.columns, *added)))


#: The query's rules and reputation in DuckDB.
#: Production parameters of the query: a page is blocked below the share of all outcomes, by one deviation, with priors of ten pages at most.
OP10 = {"good_share": None, "width": 1.0, "strongest": 10.0}
ORACLE_SQL = f"""
WITH split AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
places AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split
),
hosts AS (
  SELECT *, string_split(host, '.') AS labels,
    CASE WHEN len(string_split(host, '.')) > 2 AND length(list_extract(string_split(host, '.'), -1)) = 2 AND list_extract(string_split(host, '.'), -2) IN ({", ".join(f"'{s}'" for s in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS wide
  FROM places
),
named AS (SELECT page_id, host, path, list_aggregate(labels[-wide - 1:], 'string_agg', '.') AS domain, list_aggregate(labels[-wide:], 'string_agg', '.') AS suffix FROM hosts),
known AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcomes AS (SELECT host, domain, suffix, good FROM named JOIN known ON known.doc_id = try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT)),
by_host AS (SELECT host, domain, suffix, sum(good) AS good, count(*) AS n FROM outcomes GROUP BY ALL),
by_domain AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM by_host GROUP BY ALL),
by_suffix AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM by_domain GROUP BY ALL),
top AS (SELECT (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS share FROM by_suffix),
z0 AS (SELECT sum(n * pow(good / n - share, 2) / (share * (1 - share)) - 1) AS excess, sum(n - 1) AS freedom FROM by_suffix, top),
m0 AS (SELECT CASE WHEN coalesce(excess, 0) <= 0 OR coalesce(freedom, 0) = 0 THEN {OP10['strongest']} ELSE least({OP10['strongest']}, greatest({WEAKEST}, freedom / excess - 1)) END AS m FROM z0),
suffixes AS (SELECT suffix, (good + m * share) / (n + m) AS suffix_share FROM by_suffix, top, m0),
d AS (SELECT * FROM by_domain JOIN suffixes USING (suffix)),
z1 AS (SELECT sum(n * pow(good / n - suffix_share, 2) / (suffix_share * (1 - suffix_share)) - 1) AS excess, sum(n - 1) AS freedom FROM d WHERE suffix_share > 0 AND suffix_share < 1),
m1 AS (SELECT CASE WHEN coalesce(excess, 0) <= 0 OR coalesce(freedom, 0) = 0 THEN {OP10['strongest']} ELSE least({OP10['strongest']}, greatest({WEAKEST}, freedom / excess - 1)) END AS m FROM z1),
domains AS (SELECT domain, (good + m * suffix_share) / (n + m) AS domain_share FROM d, m1),
h AS (SELECT * FROM by_host JOIN domains USING (domain)),
z2 AS (SELECT sum(n * pow(good / n - domain_share, 2) / (domain_share * (1 - domain_share)) - 1) AS excess, sum(n - 1) AS freedom FROM h WHERE domain_share > 0 AND domain_share < 1),
m2 AS (SELECT CASE WHEN coalesce(excess, 0) <= 0 OR coalesce(freedom, 0) = 0 THEN {OP10['strongest']} ELSE least({OP10['strongest']}, greatest({WEAKEST}, freedom / excess - 1)) END AS m FROM z2),
posterior AS (
  SELECT page_id, named.host, path, share AS overall, coalesce(by_host.n, 0) AS labelled, coalesce(by_host.n, 0) + m AS size, (coalesce(by_host.good, 0) + m * coalesce(domain_share, suffix_share, share)) / (coalesce(by_host.n, 0) + m) AS mean
  FROM named LEFT JOIN by_host ON named.host = by_host.host LEFT JOIN domains ON named.domain = domains.domain LEFT JOIN suffixes ON named.suffix = suffixes.suffix, m2, top
),
ruled AS (
  SELECT page_id, host, path, overall, labelled, mean AS share, mean + {OP10['width']} * sqrt(mean * (1 - mean) / (size + 1)) AS upper,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    END AS rule
  FROM posterior
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper < overall THEN 'block' ELSE 'allow' END AS verdict,
  round(share, 6) AS share, round(upper, 6) AS upper, CAST(labelled AS BIGINT) AS labelled
FROM ruled
"""
