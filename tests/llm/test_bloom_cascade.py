"""The cascade's membership and verdicts against a plain reading of the rules."""

import random

from medialake.llm import bloom_cascade as bc
from medialake.llm.common import table
from tests.oracle import SF, compare, connection


def plain(url, rules, default="allow"):
    """(host, path, rule, verdict) of one url."""
    scheme, sep, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host), r.key, r.verdict), default=None)
    return host, path, best and best.key, best.verdict if best else default


def urls_and_rules(seed, n_urls, n_rules):
    rng = random.Random(seed)
    label = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(label() + "/" for _ in range(rng.randint(0, 3)))
    urls = [rng.choice(["http://", "HTTPS://", "", "x://"]) + host().upper() + path() + rng.choice(["", "?q=/a", "#b/c", "d"]) for _ in range(n_urls)]
    return urls + [None, "", "http://", "://a/b"], [bc.Rule(host() + path(), rng.choice(["allow", "block"])) for _ in range(n_rules)]


def judged(spark, urls, rules, **how):
    pages = spark.createDataFrame([(i, u, "mine", "h", 1) for i, u in enumerate(urls)], "page_id long, url string, _key string, host string, n int").repartition(3)
    rows = bc.judge(pages, rules, keep=["page_id", "host", "_key"], **how).collect()
    assert all(r["_key"] == "mine" for r in rows) and len(rows) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


def test_against_plain_rules(spark):
    """Also with lists in many shards, with several plans; verdicts of equal rules; hosts in another case."""
    urls, rules = urls_and_rules(1, 900, 400)
    rules += [bc.Rule("a/", "allow"), bc.Rule("a/", "block"), bc.Rule("B.c/a/", "block")]
    want = {i: plain(u, rules) for i, u in enumerate(urls)}
    assert len({w[2] for w in want.values()}) > 20
    assert judged(spark, urls, rules) == want
    assert judged(spark, urls, rules, shard=60) == want


def test_levels_are_exact_and_small(spark, monkeypatch):
    """Few bits a key force several levels; each key of the universe is judged rightly."""
    monkeypatch.setattr(bc, "BITS_PER_KEY", 3)
    monkeypatch.setattr(bc, "bits_for", lambda n, others: 64 * max(1, -(-n * 3 // 64)))
    universe = spark.range(4000).selectExpr("concat('k', id) as key")
    levels = bc.build_cascade(universe, universe.where("key like '%7'"))
    assert len(levels) >= 4
    wrong = universe.where(bc.is_listed(universe["key"], levels) != universe["key"].like("%7"))
    assert wrong.count() == 0


def test_level_0_grows_with_the_list_alone():
    assert bc.bits_for(4, 10**10) < 64 * 64 and bc.bits_for(10**6, 10**9) < 26 * 10**6


def test_edge_cases(spark):
    assert judged(spark, ["http://a/b", None], []) == {0: ("a", "/b", None, "allow"), 1: ("", "", None, "allow")}
    pages = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/")], "page_id long, url string")
    assert [r["verdict"] for r in bc.judge(pages, bc.CONTRACT_RULES).collect()] == ["block", "block"]
    assert bc.judge(pages.limit(0), bc.CONTRACT_RULES).count() == 0
    assert compare(bc.judge(table(spark, SF, "pages"), bc.CONTRACT_RULES, keep=["page_id"]), connection(SF), bc.ORACLE_SQL) > 0


def test_no_python_in_the_plan(spark):
    plan = bc.judge(table(spark, SF, "pages"), bc.CONTRACT_RULES, keep=["page_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
