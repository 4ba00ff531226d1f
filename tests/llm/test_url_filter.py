"""The URL automaton against rule-by-rule matching."""

import random

import numpy as np
import pytest

from bibspark.llm import url_filter as u

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plainly(url, rules):
    host, path = u.split_url(url)
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        at_host = host == h.encode() or host.endswith(b"." + h.encode())
        if at_host and path.startswith((slash + p).encode()):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, "allow")


@pytest.mark.parametrize("rules", [RULES, RULES + [(f"a{i}.very.long.host.name.org/p{i}/q", "block") for i in range(40)], []])
def test_equals_matching_each_rule(rules):
    rng = random.Random(3)
    hosts = ["example", "net", "com", "org", "a1.very.long.host.name", "xnet", "", "EN"]
    urls = []
    for _ in range(4000):
        host = ".".join(rng.choices(hosts, k=rng.randrange(4)))
        path = rng.choice(["", "/", "/en/", "/en", "/fr/x", "/de/1", "/p1/q/r", "/net/en/", ".net/", "/a.net/"])
        urls.append((rng.choice(["http://", "", "x://", "://"]) + host + path + rng.choice(["", "?a=/en/", "#x://y"])).encode())
    auto = u.compile_rules(rules)
    found = u.longest_rule(auto, np.array([len(r) for r, _ in rules], int),
                           [h + b"#" + p for h, p in map(u.split_url, urls)])
    verdicts = dict(rules)
    got = [(rules[k][0], verdicts[rules[k][0]]) if k >= 0 else (None, "allow") for k in found]
    assert got == [plainly(x, rules) for x in urls]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?y#z"), (4, "http://A.Example.NET/en/x?y#z"),
            (None, "https://x.net"), (5, "https://x.net/"), (6, "http://é.org/fr/ü"), (7, "http://" + "a." * 20000 + "net/" + "b" * 50000)]
    pages = spark.createDataFrame([(i, x, "h", "c", "r") for i, x in rows], "page_id long, url string, host string, rule string, verdict string")
    got = u.judge(pages, RULES).collect()
    by = {r.page_id: (r.host[:15], r.path[:9], r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[None] == ("x.net", "", None, "allow") and by[5][2:] == ("net/", "block")
    assert by[6] == ("é.org", "/fr/ü", "org/fr/", "allow") and by[7][2:] == ("net/", "block")
    assert u.judge(pages.limit(0), RULES).count() == 0


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        u.compile_rules([("a/", "allow"), ("a/", "block")])
    with pytest.raises(ValueError):
        u.compile_rules([("a", "allow")])
