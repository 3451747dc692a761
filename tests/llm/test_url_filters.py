import itertools
import random

from metrolith.llm import url_filters as U
from pyspark.sql import functions as F

LISTED = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URLS = [
    (1, "http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    (2, "https://www.Example.COM/en/2?x#y", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    (3, "https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    (4, "https://m.example.com", "m.example.com", "", None, "allow"),
    (5, "https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    (6, "http://a.net/fr", "a.net", "/fr", None, "allow"),
    (7, "http://a.net/fr/#x", "a.net", "/fr/", "net/fr/", "block"),
    (8, "http://net/es/q", "net", "/es/q", "net/es/", "block"),
    (9, None, "", "", None, "allow"), (10, "no scheme", "", "", None, "allow"), (11, "", "", "", None, "allow"),
    (12, "a://b://c.net/es/", "b:", "//c.net/es/", None, "allow"), (12, "a://b://c.net/es/", "b:", "//c.net/es/", None, "allow"),
    (13, "ftp://É.NET?/es/", "É.net", "", None, "allow"),
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([r[:2] for r in URLS], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit("clash")})
    out = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(pages, LISTED, None).collect())
    assert out == sorted((i, h, p, r or "", v) for i, _, h, p, r, v in URLS)
    assert U.judge(pages.where("false"), LISTED, None).count() == 0


def test_mined_rules_match_brute_force(spark):
    rows = [(f"http://{'bad' if i % 5 == 0 else 'good'}.org/{'x' if i % 2 else 'y'}/{i}", i % 5 == 0 and i % 10 != 0) for i in range(400)]
    labelled = spark.createDataFrame([*rows, (None, True), ("none", None)], "url string, bad boolean")
    rules = U.mine(labelled, U.Settings(min_support=0.02))
    sets = [set(r.tokens) for r in rules.collect()]
    assert {"host:bad", "path:x"} in sets and not any(a < b for a in sets for b in sets)
    out = U.judge(labelled, LISTED, rules, keep=("url",)).collect()
    held = {r.url: set(r.t) for r in labelled.select("url", U.tokens(F.col("url")).alias("t")).collect()}
    assert len(out) == labelled.count()
    for r in out:
        assert (r.verdict == "block") == any(s <= held[r.url] for s in sets), r.url
    assert U.mine(labelled.where("bad is null")) is None


def test_long_urls_end_in_seconds_and_rules_need_pages(spark):
    path = "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(f"http://spam.org/{path}", True)] * 15 + [(f"http://good{'abcde'[i % 5]}.org/{path}/x", False) for i in range(45)] + [("http://rare.org/odd/page", True)] * 3
    rules = U.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert ["host:spam"] in [r.tokens for r in rules] and not any("host:rare" in r.tokens for r in rules)
    assert U.mine(spark.createDataFrame(rows[:4], "url string, bad boolean")) is None


def plain_rules(rows, s):
    """Of all sets of tokens, those that are a rule and hold no other one; rows: tokens, bad."""
    n, n_bad = len(rows), sum(bad for _, bad in rows)
    support, rules = max(s.min_support, s.min_pages / n) * n, []
    for size in range(1, max(len(t) for t, _ in rows) + 1):
        for one in {frozenset(x) for t, bad in rows if bad for x in itertools.combinations(sorted(t), size)}:
            here = [bad for t, bad in rows if one <= t]
            share = sum(here) / len(here)
            if sum(here) >= support - 1e-9 and share >= s.min_confidence and share >= s.min_lift * n_bad / n and not any(r < one for r in rules):
                rules.append(one)
    return set(rules)


def test_rules_of_odd_labels_match_brute_force(spark):
    for seed in range(3):
        draw = random.Random(seed)
        words = [f"w{chr(97 + i)}" for i in range(6)]
        rows = []
        for _ in range(300):
            own = [w for w in words if draw.random() < 0.5]
            own += ["twin"] * ("wa" in own) + ["pair", "peer"] * ("wb" in own and "wc" in own)
            rows.append((f"http://h.org/{'/'.join(own)}", draw.random() < (0.9 if {"wb", "wd"} <= {*own} or {"wa", "wc", "we"} <= {*own} else 0.15)))
        df = spark.createDataFrame(rows, "url string, bad boolean")
        s = U.Settings(min_support=0.03)
        held = [(frozenset(r.t), r.bad) for r in df.select("bad", U.tokens(F.col("url")).alias("t")).collect()]
        rules = U.mine(df, s).collect()
        every = {frozenset(x) for r in rules for x in itertools.product(*r.groups)}
        assert every == plain_rules(held, s) and any(len(x) > 1 for x in every)
        assert all(r.tokens == sorted(g[0] for g in r.groups) and r.key in r.groups for r in rules)


def test_rules_reach_every_token_of_a_long_url(spark):
    """left and right say it together; each is blocked less often than twenty other tokens of the same pages."""
    path = "/".join(f"s{chr(97 + i)}{chr(98 + i % 7)}" for i in range(20))
    rows = [(f"http://h.org/{path}/left/right", True)] * 20 + [(f"http://h.org/{path}", False)] * 20
    rows += [(f"http://h.org/{side}/{'abcd'[i % 4]}", i < 4) for i in range(40) for side in ("left", "right")]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = U.mine(df, U.Settings(min_support=0.1))
    assert ["path:left", "path:right"] in [r.tokens for r in rules.collect()]
    new = spark.createDataFrame([(1, "http://other.net/left/x/right"), (2, "http://other.net/left/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(new, LISTED, rules).collect()} == {1: "block", 2: "allow"}
