import html
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import styletree
from millrace.llm.catalog import op13_html


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in styletree.main_texts(df).collect()}


def one(page, low=frozenset()):
    return styletree.main_text(page.encode(), "h", low)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_gives_the_articles(spark, folder):
    """The given pages declare their article; what is inside comes block by block, the rest goes."""
    want = {}
    for p in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inside = re.search("<article>(.*?)</article>", p["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        want[p["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op13_html(spark, folder).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def plain_importance(pages):
    """The trees built one host at a time, importance by recursion."""
    out = {}
    for host in {h for h, _ in pages}:
        own = {}
        for page in {p for h, p in pages if h == host}:
            for row in set(styletree.branches(styletree.parse(page), host)):
                own.setdefault((row[2], row[3]), []).append((row[1], row[4], page))
        below = defaultdict(set)
        for (node, text), rows in own.items():
            for up, _, _ in rows:
                below[up].add((node, text))

        def branch(key):
            rows, m = own[key], len({p for _, _, p in own[key]})
            values = defaultdict(int)
            for _, value, _ in rows:
                values[value] += 1
            total = sum(values.values())
            if key[1]:
                return 1.0 if m == 1 else max(0.0, 1 - sum(math.log(n) for n in values.values()) / len(values) / math.log(m))
            alone = 1.0 if m == 1 else min(1.0, -sum(n / total * math.log(n / total) for n in values.values()) / math.log(m))
            inner = sum(n / total * sum(map(branch, below[v])) / len(below[v]) for v, n in values.items())
            faded = styletree.GAMMA ** len(values)
            return (1 - faded) * alone + faded * inner

        out |= {key: branch(key) for key in own}
    return out


def site(n, host="h"):
    """Pages without a word that declares anything: a box that all share, a box of two kinds, and own text of different shapes."""
    for k in range(n):
        own = "".join(f"<p>own {k} {j}</p>" + ("<table><tr><td>x%d</table>" % k if (k + j) % 3 == 0 else "") for j in range(1 + k % 3))
        yield (host, f"<div class=a><p>always</p><p>the same</p></div><div class=b>kind {k % 2}</div><div class=c{k}>{own}</div><div class=a>always</div>")


def test_importance_equals_the_tree_built_plainly(spark):
    pages = [*site(9), *site(2, "g"), *site(1, "f"), *list(site(9))[:3]]
    df = spark.createDataFrame(pages, "host string, html string").select("host", F.col("html").cast("binary").alias("html"))
    rows = df.distinct().select(F.explode(styletree._profiles("html", "host")).alias("r")).select("r.*")
    got = {(r["node"], r["text"]): r["importance"] for r in styletree.importance(rows).collect()}
    want = plain_importance(pages)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_branches_that_a_site_repeats_go_and_those_of_one_page_stay(spark):
    pages = [(k, f"http://h/{k}", p) for k, (_, p) in enumerate(site(12))] + [(99, "http://alone/1", next(site(1))[1])]
    got = texts(spark, pages)
    for k in range(12):
        assert "always" not in got[k] and "the same" not in got[k] and "kind" not in got[k]
        assert got[k].startswith(f"own {k} 0")
    assert got[99].split("\n")[:3] == ["always", "the same", "kind 0"]


def test_copies_of_one_page_keep_their_text(spark):
    page = "<div><p>one</p><ul><li>item</ul></div>"
    article = "<nav>menu</nav><article><h1>t</h1><p>one</p><div><p>boxed</p></div></article>"
    got = texts(spark, [(k, "http://h/", page) for k in range(5)] + [(10 + k, "http://g/", article + f"<p>{k}") for k in range(5)])
    assert {got[k] for k in range(5)} == {"one\nitem"}
    assert all(got[10 + k].startswith("t\none\nboxed") for k in range(5))


def test_boxes_inside_articles_that_a_site_repeats(spark):
    pages = [(k, f"http://h/{k}", f"<main><p>text {k}</p><p>a license line</p><div><p>follow us</p></div></main>") for k in range(8)]
    assert all(t == f"text {k}\na license line" for k, t in texts(spark, pages).items())


def test_declared_content():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div id="cookieNotice">accept</div><div class='ad-box'>buy</div>
    <form id=all><article><header><h1>Title &amp; more</h1></header><p>First<br>line &copy &lt;b&gt;&nbsp;x<p>Second <b>bold <i>and</i><p>third
    <!-- <p>no</p> --><aside>side</aside><section class="comments"><p>I disagree</section><div class="comment">no</div><footer>by me</footer></article></form>
    <noscript>enable</noscript><textarea>typed</textarea><select><option>a</select><button>Go</button><footer>end</footer></body>"""
    assert one(page) == "Title & more\nFirst line © <b> x\nSecond bold and\nthird"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain", "plain"),
        ("a < b &am; &#65;&#x42;&unknown;", "a < b &am; AB&unknown;"),
        ("<p>one<p>two</div>three", "one\ntwo\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a\nb\nc\nd\ne"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
        ("<p>x<script>never closed <p>y", "x"),
        ("<!-- open <p>x", ""),
        ('<p title="a > b">x</p><p title=\'"\'>y', "x\ny"),
        ("<div " + "x" * 50 + ">t", "t"),
        ("<P>Up<HR>per</P >", "Up\nper"),
    ],
)
def test_markup(page, text):
    assert one(page) == text


def test_deep_and_long_pages():
    assert one("<div>" * 5000 + "x" + "<b>" * 5000 + "y") == "xy"
    assert one("<p>" + "word " * 200_000).count("word") == 200_000
    assert len(one("<p>a</p>" * 20_000).split("\n")) == 20_000


def test_branches_below_the_deepest_level_follow_the_one_above(spark, monkeypatch):
    pages = [(k, f"http://h/{k}", "<div>" * 30 + "<p>menu</p>" + "</div>" * 30 + "<section>" + "<div>" * 30 + f"<p>own {k}") for k in range(6)]
    assert texts(spark, pages) == {k: f"own {k}" for k in range(6)}


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(1, "http://h/1", None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "no scheme", ""), (None, "http://h/2", "<nav>n</nav>")]
    df = spark.createDataFrame([(*r, 0, "k", "n") for r in rows], "page_id long, url string, html string, k int, host string, text string")
    out = styletree.main_texts(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted((str(r["page_id"]), r["text"], r["host"]) for r in out.collect()) == [("1", "", "k"), ("2", "x", "k"), ("2", "x", "k"), ("3", "", "k"), ("None", "", "k")]
    assert styletree.main_texts(df.limit(0)).count() == 0
