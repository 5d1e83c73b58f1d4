import math
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import queries, urls

RULES = "verdict string, host string, path string"
GOOD = "host string, good int"


def judged(spark, found, rules=(), outcomes=(), **more):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id int, url string")
    rows = urls.judge_urls(pages, spark.createDataFrame(list(rules), RULES), spark.createDataFrame(list(outcomes), GOOD), **more).collect()
    return {r["page_id"]: r for r in rows}


def test_parts(spark):
    rows = judged(spark, ["HTTP://A.Example.COM:80/x/Y?q=/z#t", "no scheme", None, "a://b", "a://?x", "x://h#/p", "a://É.Ü/ä"])
    want = [("a.example.com:80", "/x/Y"), ("", ""), ("", ""), ("b", ""), ("", ""), ("h", ""), ("É.Ü", "/ä")]
    assert [(rows[i]["host"], rows[i]["path"]) for i in range(len(want))] == want


def test_longest_rule_wins(spark):
    found = ["x://a.com/en/1", "x://example.com/en/1", "x://b.example.com/en", "x://www.example.com/en/", "x://m.www.example.com/en/z", "x://notexample.com/en/", "x://a.net/es/1", "x://a.net/de/", "x://com", "x://com/"]
    rows = judged(spark, found, queries.RULES)
    want = ["com/", "example.com/en/", "com/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, None, "com/"]
    assert [rows[i]["rule"] for i in range(len(found))] == want
    assert [rows[i]["verdict"] for i in range(len(found))] == ["allow", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow", "allow"]


def test_many_rules_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 2)
    test_longest_rule_wins(spark)


def brute_upper(outcomes, host, domain, suffix):
    def strength(rows):
        rows = [(g, n, p) for g, n, p in rows if n and 0 < p < 1]
        excess = sum(n * (g / n - p) ** 2 / (p * (1 - p)) - 1 for g, n, p in rows)
        freedom = sum(n - 1 for _, n, _ in rows)
        return urls.STRONGEST if excess <= 0 or not freedom else min(urls.STRONGEST, max(urls.WEAKEST, freedom / excess - 1))

    h, d, s = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for x, good in outcomes:
        for level, key in ((h, x), (d, ".".join(x.split(".")[-2:])), (s, x.split(".")[-1])):
            level[key][0] += good
            level[key][1] += 1
    top = (sum(g for g, _ in s.values()) + 0.5) / (sum(n for _, n in s.values()) + 1)
    m = strength([(g, n, top) for g, n in s.values()])
    ss = {k: (g + m * top) / (n + m) for k, (g, n) in s.items()}
    up = lambda k: ss[k.split(".")[-1]]
    m = strength([(g, n, up(k)) for k, (g, n) in d.items()])
    ds = {k: (g + m * up(k)) / (n + m) for k, (g, n) in d.items()}
    up = lambda k: ds[".".join(k.split(".")[-2:])]
    m = strength([(g, n, up(k)) for k, (g, n) in h.items()])
    prior = ds.get(domain, ss.get(suffix, top))
    g, n = h.get(host, (0, 0))
    share, size = (g + m * prior) / (n + m), n + m
    return share + urls.WIDTH * math.sqrt(share * (1 - share) / (size + 1))


def test_reputation_shrinks_and_blocks(spark):
    outcomes = [("bad.x.org", 0)] * 60 + [("ok.x.org", 1)] * 60 + [("few.x.org", 0)] * 1 + [("a.y.org", 1)] * 30 + [("b.y.net", 1)] * 20 + [("b.y.net", 0)] * 4
    hosts = ["bad.x.org", "ok.x.org", "few.x.org", "new.x.org", "new.z.org", "new.net", "else.de"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: r["upper"] for r in urls.host_reputation(spark.createDataFrame(outcomes, GOOD), frame).collect()}
    for x in hosts:
        assert abs(got[x] - brute_upper(outcomes, x, ".".join(x.split(".")[-2:]), x.split(".")[-1])) < 1e-9
    rows = judged(spark, [f"x://{x}/" for x in hosts], (), outcomes)
    assert [rows[i]["verdict"] for i in range(len(hosts))] == ["block"] + ["allow"] * 6


def test_country_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.b.de", "localhost", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(urls.suffix_of(F.col("h")), urls.domain_of(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("uk", "co.uk"), ("de", "b.de"), ("localhost", "localhost"), ("", "")]


def test_awkward_rows(spark, tricky, nothing):
    rules, outcomes = spark.createDataFrame(queries.RULES, RULES), spark.createDataFrame([], GOOD)
    pages = tricky.withColumn("url", F.when(F.col("doc_id") % 2 == 0, F.lit("x://a.com/p")))
    out = urls.judge_urls(pages, rules, outcomes)
    assert out.columns == [*pages.columns, "host_", "path", "rule", "verdict_", "share", "upper", "labelled"]
    assert out.count() == pages.count() and out.where("verdict_ = 'allow'").count() == pages.count()
    assert urls.judge_urls(nothing.withColumn("url", F.col("text")), rules, outcomes).count() == 0


def test_column_names_with_dots(spark):
    pages = spark.createDataFrame([(1, "x://a.com/p", 5), (2, "x://b.org/p", 6), (2, "x://b.org/p", 6)], ["page.id", "url", "a.b"])
    out = urls.judge_urls(pages, spark.createDataFrame(queries.RULES, RULES), spark.createDataFrame([("b.org", 0)], GOOD))
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "x://a.com/p", 5, "a.com"), (2, "x://b.org/p", 6, "b.org"), (2, "x://b.org/p", 6, "b.org")]


def test_a_path_number_names_the_document_of_a_page(spark, sf_dir):
    """The outcomes rest on this: every word of the document that a path numbers stands in the page."""
    import re

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    shares = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        number = re.search("://[^/?#]*/[a-z]+/([0-9]+)", r["url"] or "")
        if number and docs.get(int(number.group(1))):
            own, shown = (set(re.findall(r"\w{4,}", t)) for t in (docs[int(number.group(1))], r["html"]))
            shares.append(len(own & shown) / max(1, len(own)))
    assert len(shares) > 20 and sum(s > 0.95 for s in shares) >= 0.95 * len(shares)


def test_reputation_decides_in_the_query(spark):
    rows = queries.op10_urls(spark, "/root/testdata/sf0.01").where("rule is null")
    got = {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}
    assert got["block"] > 0 and got["allow"] > got["block"]
    assert rows.where("verdict = 'block' and labelled = 0").count() == 0
