import random
import time
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import robots
from crawlspark.session import cut_lineage

FILES = [
    "User-agent: *\nDisallow: /private\nAllow: /",
    "User-agent: *\nAllow: /private/open\nDisallow: /private",
    "User-agent: Example\nDisallow: /a\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\nDisallow: /\n\nUser-agent: examplebot\nDisallow:",
    "User-agent: other\nUser-agent: example\nDisallow: /b # note\nDisallow: /c",
    "Disallow: /x\nUser-agent: *\n\nDisallow: /y",
    "User-agent: *\n\nUser-agent: *\nDisallow: /a",
    "User-agent: *\nDisallow: /*.pdf\nDisallow: /q?x=1",
    "User-agent: *\nDisallow: *",
    "User-agent: examplebot\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /",
    "# nothing\n\nSitemap: https://x.be/sitemap.xml",
    "",
    "User-agent: *\nDisallow: /a%20b\nDisallow: /%C3%A9",
    "user-AGENT : *\r\nDISALLOW : /a\r\n   \r\nDisallow: /b",
    "User-agent:\nDisallow: /a\n\nUser-agent: *\nDisallow: /b",
    "User-agent: *\nDisallow: /a\nUser-agent: examplebot\nDisallow: /b",
    "User-agent: *\nUser-agent: examplebot\nDisallow: /a\n\nUser-agent: *\nDisallow: /b",
    "garbage line\nUser-agent: *\nnot a rule\nDisallow: /a",
    "User-agent: *\nDisallow: /a?\nAllow: /a",
]
PATHS = ["", "/", "/a", "/a/b", "/a b", "/a%20b", "/b", "/c", "/x", "/y", "/private", "/private/open/x", "/z.pdf", "/*.pdf",
         "/q?x=1", "/q?x=2", "?q", "/é", "/%C3%A9", "/%zz", "/a?b=c"]


def test_rules_match_the_standard_parser(spark):
    urls = [f"https://h.be{p}" for p in PATHS]
    want = []
    for i, body in enumerate(FILES):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        want += [(i, u, parser.can_fetch("ExampleBot/1.0 (+x)", u)) for u in urls]
    files = spark.createDataFrame([(f"s{i}", 200, b) for i, b in enumerate(FILES)], "site string, status int, body string")
    asked = spark.createDataFrame([(f"s{i}", u) for i, u, _ in want], "site string, url string")
    policy = robots.robots_policy(files, "ExampleBot/1.0 (+x)")
    got = {(r.site, r.url): r.robots_ok for r in robots.robots_gate(asked, policy).collect()}
    assert [(i, FILES[i], u, w) for i, u, w in want if got[f"s{i}", u] != w] == []


def test_first_rule_of_many(spark):
    """Chains of prefixes, repeated and empty prefixes against a plain scan of the rules."""
    rng = random.Random(5)
    files, asked, want = [], [], []
    for i in range(40):
        word = lambda n: "".join(rng.choice("ab/é") for _ in range(rng.randrange(n)))
        rules = [(k, rng.random() < 0.5, "/" + word(9) if rng.random() < 0.95 else "") for k in range(rng.choice([0, 1, 2, 7, 60, 300]))]
        rng.shuffle(rules)
        files.append((f"s{i}", rules))
        for target in ["/", "/" + "a" * 50, *["/" + word(14) for _ in range(40)]]:
            asked.append((f"s{i}", target))
            want.append(min([(p, a) for p, a, x in rules if target.startswith(x)], default=(0, None))[1])
    policy = spark.createDataFrame(files, "site string, rules array<struct<rule_pos: bigint, allow: boolean, prefix: string>>")
    rows = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(asked)], "k int, site string, target string")
    got = rows.join(robots.indexed(policy), "site").select("k", robots.first_rule(F.col("target"), F.col("rules")).alias("a"))
    assert [r.a for r in got.orderBy("k").collect()] == want


def test_ten_thousand_rules(spark):
    """A file of many rules costs a URL about what a small one does."""
    def seconds(n):
        rules = [(k, k % 2 == 0, f"/p{k:05}/") for k in range(n)]
        policy = spark.createDataFrame([("s", rules)], "site string, rules array<struct<rule_pos: bigint, allow: boolean, prefix: string>>")
        index = cut_lineage(robots.indexed(policy))
        target = F.concat(F.lit("/p"), F.lpad((F.col("id") % n).cast("string"), 5, "0"), F.lit("/x"))
        urls = spark.range(40_000).select(F.lit("s").alias("site"), target.alias("t"))
        asked = urls.join(F.broadcast(index), "site").select(robots.first_rule(F.col("t"), F.col("rules")).alias("a"))
        started = time.time()
        counts = asked.agg(F.count_if("a"), F.count_if(~F.col("a"))).first()
        return time.time() - started, tuple(counts)

    seconds(10)
    (few, a), (many, b) = seconds(10), seconds(10_000)
    assert a == b == (20_000, 20_000)
    assert many < 10 * few + 3


@pytest.mark.parametrize("status,label,allowed", [
    (401, "deny_all", False), (403, "deny_all", False), (404, "allow_all", True), (410, "allow_all", True),
    (500, "unparsed", False), (None, "unreachable", True),
])
def test_load_results(spark, status, label, allowed):
    files = spark.createDataFrame([("s", status, "User-agent: *\nDisallow: /a")], "site string, status int, body string")
    urls = spark.createDataFrame([("s", "https://s/a"), ("unknown", "https://u/a")], "site string, url string")
    got = {r.site: (r.robots_status, r.robots_ok) for r in robots.robots_gate(urls, robots.robots_policy(files, "b")).collect()}
    assert got == {"s": (label, allowed), "unknown": ("unreachable", True)}


def test_rule_rows(spark):
    files = spark.createDataFrame([("s", 200, FILES[4])], "site string, status int, body string")
    rows = robots.robots_rules(files).orderBy("rule_pos").collect()
    assert [(r.agents, r.rule_pos, r.allow, r.prefix) for r in rows] == [
        ("example,other", 2, False, "/b"), ("example,other", 3, False, "/c")]


def test_selectable_reasons(spark):
    seeds = spark.createDataFrame([(1, "https://h.be/", "h.be"), (2, "https://www.h.be:443/", "www.h.be")], "seed_id long, url string, host string")
    files = spark.createDataFrame(
        [("https://h.be", 200, "User-agent: *\nDisallow: /no"), ("https://www.h.be:443", 200, "User-agent: *\nDisallow: /ok")],
        "site string, status int, body string")
    urls = spark.createDataFrame(
        [(1, 1, "https://www.h.be/ok"), (1, 2, "https://h.be/no"), (1, 3, "https://else.be/"),
         (2, 4, "https://www.h.be/ok"), (2, 5, "https://h.be/no")], "seed_id long, pos long, url string")
    got = robots.selectable_verdict(urls, seeds, robots.robots_policy(files, "bot")).orderBy("pos").collect()
    assert [(r.selectable, r.reason) for r in got] == [(True, "ok"), (False, "robots"), (False, "other_host"), (False, "robots"), (True, "ok")]
