import math
from collections import Counter, defaultdict

import xxhash

from millrace.llm import urlfilter as u

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fits = [(len(t), t, v) for v, t in RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def plain_judge(urls):
    """url -> (score, verdict)"""
    says = {x: plain_rule(*plain_parts(x))[1] for x in urls}
    fifth = lambda x: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(x.encode(), 42)) % 5 == 0
    clean = lambda x: "".join(c if " " <= c <= "~" else "?" for c in x or "")
    models = {}
    for c in ("allow", "block"):
        counts = [defaultdict(Counter) for _ in range(5)]
        for x in urls.elements():
            if says[x] == c and not fifth(x):
                t = "    " + clean(x)
                for i in range(4, len(t)):
                    for k in range(5):
                        counts[k][t[i - k : i]][t[i]] += 1
        models[c] = counts

    def p(c, context, char):
        out = 1 / 95
        for k in range(5):
            followers = models[c][k].get(context[4 - k :])
            if followers:
                n, kinds = sum(followers.values()), len(followers)
                out = (followers[char] + kinds * out) / (n + kinds)
        return out

    scores = {}
    for x in urls:
        t = "    " + clean(x)
        ratios = [math.log2(p("allow", t[i - 4 : i], t[i])) - math.log2(p("block", t[i - 4 : i], t[i])) for i in range(4, len(t))]
        scores[x] = sum(ratios) / len(ratios) if ratios else 0.0
    held = [(math.floor(round(scores[x], 6) * 64), says[x]) for x in urls if says[x] and fifth(x)]
    a, b = (sum(s == c for _, s in held) for c in ("allow", "block"))
    cut = 0.0
    if a and b:
        cut = min((round(sum(s == "allow" for y, s in held if y < x) / a + 1 - sum(s == "block" for y, s in held if y < x) / b, 12), abs(x), x) for x, _ in held)[2] / 64
    return {x: (scores[x], says[x] or ("allow" if round(scores[x], 6) >= cut else "block")) for x in urls}


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    want = plain_judge(Counter(p.url for p in pages))
    got = {r.page_id: r for r in u.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.host, r.path) == plain_parts(p.url)
        assert r.rule == plain_rule(r.host, r.path)[0]
        assert abs(r.score - want[p.url][0]) < 2e-6
        assert r.verdict == want[p.url][1]


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "x://Example.NET/en/1?q#f", "x://notexample.net/en/", "x://é.example.com/de/x", "y://b.org/fr/", "y://b.org/fr", "z://c/" + "long" * 5000]
    rows = [(i, x, "h") for i, x in enumerate(urls)] + [(None, "http://a.net/", "h")] * 2
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, x in enumerate(urls):
        assert (by[i].host, by[i].path) == plain_parts(x)
        assert by[i].rule == plain_rule(*plain_parts(x))[0]
    assert by[4].rule is None and by[5].verdict == "block" and by[6].rule == "example.net/en/"
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
