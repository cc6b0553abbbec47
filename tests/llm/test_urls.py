"""URL rules and host reputation against a plain version, on odd urls, hot hosts and empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from assayframe.llm import urls
from pyspark.sql import functions as F

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "bad.org/"), ("allow", "bad.org/x"), ("block", "co.uk/p")]
SCHEMA = "page_id long, url string, host string, n long, bad long, rows long, suffix string, bound double"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [(v, r) for v, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda f: len(f[1]), default=(None, None))


def domain(host):
    bare = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))
    if re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", bare):
        return bare, bare
    labels, two = bare.split("."), ".".join(bare.split(".")[-2:])
    return (".".join(labels[-3:]), two) if two in urls.SUFFIXES else (two, labels[-1])


def posteriors(outcomes):
    """{host: (n, bad, mean, variance)} from {host: [outcome, ...]}, level by level."""
    everything = [o for own in outcomes.values() for o in own]
    mean = (sum(everything) + 1) / (len(everything) + 2)
    above = {None: (mean, mean * (1 - mean) / (len(everything) + 3))}
    for key, parent in ((lambda h: domain(h)[1], lambda h: None), (lambda h: domain(h)[0], lambda h: domain(h)[1]), (lambda h: h, lambda h: domain(h)[0])):
        groups, prior = defaultdict(list), {}
        for h, own in outcomes.items():
            groups[key(h)] += own
            prior[key(h)] = above[parent(h)]
        seen = {g: (len(o), sum(o), prior[g][0]) for g, o in groups.items() if o}
        room = math.fsum(m * (1 - m) * (n - 1) for n, _, m in seen.values())
        excess = math.fsum(n * (b / n - m) ** 2 - m * (1 - m) for n, b, m in seen.values())
        weight = 1 / min(0.99, max(0.01, excess / room if room > 0 else 0.5)) - 1
        above = {}
        for g, o in groups.items():
            m = (sum(o) + weight * prior[g][0]) / (len(o) + weight)
            above[g] = (m, m * (1 - m) / (len(o) + weight + 1) + (weight / (len(o) + weight)) ** 2 * prior[g][1])
    return {h: (len(o), sum(o), *above[h]) for h, o in outcomes.items()}


def expected(rows, rules=RULES, outcome=None):
    outcomes, read = defaultdict(list), []
    for i, url in rows:
        host, path = parts(url)
        verdict, rule = rule_of(host, path, rules)
        known = verdict and verdict == "block" if outcome is None else outcome(url)
        outcomes[host] += [] if known is None else [bool(known)]
        read.append((i, host, path, rule, verdict))
    post = posteriors(outcomes)
    out = []
    for i, host, path, rule, verdict in read:
        n, bad, mean, variance = post[host]
        bound = mean - 1.645 * math.sqrt(variance)
        out.append((i, host, path, rule, verdict or ("block" if bound > 0.5 else "allow"), n, bad, round(bound, 4)))
    return Counter(out)


def make(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, 2, 3, "s", 0.5) for i, u in rows], SCHEMA).repartition(4)


def got(df):
    return Counter(tuple(r) for r in df.collect())


ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/EN/x", "http://www.example.com/en/y", "http://a.www.example.com/en/y?x=/en/", "http://example.com", "http://example.com?/en/",
    "http://example.com#/en/", "https://x.Example.com/en/1#a?b", "ftp://u:p@shop.co.uk:80/p/1", "http://shop.co.uk/q", "http://co.uk/p", "http://10.0.0.1/en/", "http://10.0.0.1:8080/", "a://b://c/d",
    "http://É.example.net/es/é", "http://notnet/es/", "http://xnet/es/", "http://bad.org/x/1", "http://bad.org/y", "http://sub.bad.org/x", "http://bad.org/y\nz", "http://x.net/" + "p" * 200_000, "http://[::1]/x",
]


def test_rules_and_reputation(spark):
    rng = random.Random(1)
    rows = list(enumerate(ODD)) + [(None, None), (None, "http://q.net/es/"), (5, "http://q.net/es/"), (5, "http://q.net/es/")]
    hosts = [f"{a}{b}" for a in ("", "www.", "m.", "blog.") for b in ("example.com", "one.net", "two.net", "bad.org", "good.org", "shop.co.uk", "else.co.uk")]
    rows += [(100 + i, f"https://{rng.choice(hosts)}/{rng.choice(('en', 'es', 'x', 'p', ''))}/{i}") for i in range(1500)]
    rows += [(5000 + i, f"https://hot.one.net/{('es', 'fr', 'de')[i % 3]}/{i}") for i in range(1200)]  # a hot host
    out = got(urls.judge(make(spark, rows), RULES))
    assert out == expected(rows)
    verdicts = {(r[3] is None, r[4]) for r in out}
    assert verdicts == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def test_outcomes_of_other_labels(spark):
    """Hosts of one registered domain lean on it, a host with many outcomes of its own does not."""
    rows = [(i, f"http://h{i % 40}.spam.net/{'bad' if (i // 40) % 10 else 'fine'}/") for i in range(2000)]
    rows += [(9000, "http://new.spam.net/page"), (9001, "http://new.other.net/page")] + [(9100 + i, "http://clean.spam.net/fine/") for i in range(400)]
    label = lambda u: None if "/page" in u else "/bad/" in u
    known = F.when(F.col("url").contains("/page"), F.lit(None)).otherwise(F.col("url").contains("/bad/"))
    out = urls.judge(make(spark, rows), [], known)
    assert got(out) == expected(rows, [], label)
    by_id = {r.page_id: r for r in out.collect()}
    assert by_id[9100].verdict == "allow" and by_id[1].verdict == "block" and by_id[9000].bound > by_id[9001].bound > by_id[9100].bound


def test_no_rules_no_rows(spark):
    rows = [(1, "http://a.com/x"), (2, None)]
    assert {r.verdict for r in urls.judge(make(spark, rows), []).collect()} == {"allow"}
    assert urls.judge(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    with pytest.raises(ValueError, match="rules"):
        urls.fitting_rule(F.lit("h"), F.lit("p"), [("allow", f"h{i}/") for i in range(urls.MAX_RULES + 1)])


def test_longest_rule_wins_and_ties(spark):
    one = spark.range(1)
    pick = lambda host, path, rules: one.select(urls.fitting_rule(F.lit(host), F.lit(path), rules).alias("r")).first().r
    assert tuple(pick("a.b.com", "/xy", [("allow", "b.com/x"), ("block", "com/xy"), ("block", "b.com/")])) == ("allow", "b.com/x")
    assert tuple(pick("b.com", "/x", [("allow", "b.com/"), ("block", "com/x")])) == ("allow", "b.com/")  # the longer host
    assert tuple(pick("b.com", "/x", [("allow", "b.com/"), ("block", "b.com/")])) == ("block", "b.com/")
    assert pick("bcom", "/x", [("allow", "com/")]) is None


def test_keep(spark):
    rows = [(1, "http://a.com/x"), (2, "http://a.net/es/"), (3, None), (None, "http://b.com/"), (1, "http://b.net/es/")]
    kept = urls.keep(make(spark, rows), RULES)
    assert kept.columns == make(spark, rows).columns
    assert Counter((r.page_id, r.url) for r in kept.collect()) == Counter([(1, "http://a.com/x"), (3, None), (None, "http://b.com/")])
