import itertools
import random
import re

from pyspark.sql import functions as F

from inkwitness.llm.url_rules import RULES, judged, mine, taught, tokens_of


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def explicit(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/EN/x", "http://example.net/en/", "x://example.net/en", "http://net", "http://net/", "https://badexample.com/de/",
       "http://example.com/de/?a=b#c", "http://example.com#/de/", "http://ÄÖ.Example.Org/fr/é", "a://b://example.com/de/", "http://sub.example.org/fr/\nnew line", "http://x.org/fr"]


def test_hosts_paths_and_rules(spark, docs):
    rows = [(i, u, "x") for i, u in enumerate(ODD)] * 2
    none = mine(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean"))
    got = judged(docs(rows, "page_id long, url string, rule string"), none).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(ODD[r.page_id])
        rule = explicit(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.name, rule.verdict if rule else "allow")


def test_mined_rules_equal_brute_force(spark, docs):
    draw, rows, labels = random.Random(4), [], []
    for i in range(900):
        host = draw.choice(["casino", "news", "blog", "shop", "a.casino"]) + draw.choice([".info", ".biz", ".com"])
        url = f"http://{host}/{draw.choice(['win', 'story', 'about'])}/{draw.randrange(99)}" + draw.choice(["", "?ref=x", "?page=2&ref=y"])
        rows.append((i, url))
        odds = 0.85 if "casino" in host and "/win/" in url else 0.6 if ".biz" in host and "ref=" in url else 0.1
        if i % 3:
            labels.append((i, draw.random() < odds))
    labels += [(None, True), (5, None), (10 ** 6, True)]
    pages, told = docs(rows + [(2000, None)], "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    mined = mine(pages, told)
    got = {frozenset(r.tokens): r.confidence for r in mined.collect()}
    held = {r.page_id: frozenset(r.t) for r in docs(rows, "page_id long, url string").select("page_id", tokens_of(F.col("url")).alias("t")).collect()}
    known = [(held[i], bad) for i, bad in labels if bad is not None and i in held]
    count, hits = {}, {}
    for items, bad in known:
        for size in range(1, len(items) + 1):
            for chosen in itertools.combinations(sorted(items), size):
                key = frozenset(chosen)
                count[key], hits[key] = count.get(key, 0) + 1, hits.get(key, 0) + bad
    base = sum(b for _, b in known) / len(known)
    least = max(0.001, 25 / len(known)) * len(known)
    good = {k: hits[k] / count[k] for k in count if hits[k] >= least and hits[k] / count[k] >= 0.5 and hits[k] / count[k] >= 1.5 * base}
    want = {k: c for k, c in good.items() if not any(f < k and good[f] >= c for f in good)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    verdicts = {r.page_id: r for r in judged(pages, mined, rules=()).collect()}
    for i, _ in rows:
        assert verdicts[i].verdict == ("block" if any(k <= held[i] for k in want) else "allow")
    assert verdicts[2000].verdict == "allow"


def test_explicit_verdicts_teach_rules_for_other_pages(spark, docs):
    rows = [(i, f"http://h{i}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i // 3 % 3]}/{i}", "x") for i in range(360)]
    pages = docs(rows, "page_id long, url string, bad string")
    labels = spark.createDataFrame([(i, False, "y") for i in range(0, 360, 5)] + [(None, True, "y")], "page_id long, bad boolean, url string")
    told = taught(pages, labels)
    want = {}
    for i, url, _ in rows:
        rule = explicit(*parts(url))
        if rule or i % 5 == 0:
            want[i] = rule.verdict == "block" if rule else False
    assert {r.page_id: r.bad for r in told.collect() if r.page_id is not None} == want
    mined = mine(pages, told)
    got = judged(pages, mined).collect()
    by_method = [r for r in got if r.rule is None and r.verdict == "block"]
    assert mined.count() > 0 and by_method and all(r.host.endswith(".org") and r.path.startswith("/de/") for r in by_method)
    assert all(r.verdict == explicit(r.host, r.path).verdict for r in got if r.rule)
