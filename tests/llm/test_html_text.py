import math
import time
from collections import Counter

import pyarrow.parquet as pq

from folioweave.llm import html_text as h


def brute_cuts(pages, prior=True):
    """Styles to cut of each host: the style tree by recursion over its nodes. pages: (url, html)."""
    counts, above, below = {}, {}, {}
    for url, source in pages:
        features, named = h.page_features(*h.read_page(source or "", prior))
        of = counts.setdefault(h.host_of(url), {})
        for style, leaf, feature in features:
            of.setdefault(style, {True: Counter(), False: Counter()})[leaf][feature] += 1
        for style, node in named.items():
            above[h.host_of(url), style] = [x for x in node.chain() if x in named]
    for (host, style), chain in above.items():
        if chain:
            below.setdefault((host, chain[-1]), set()).add(style)
    cuts = {}
    for host, of in counts.items():

        def composite(style):
            """(composite, largest composite of the branch), None without text in it."""
            texts, shapes = of[style][True], of[style][False]
            m = sum(shapes.values())
            content = None
            if texts:
                content = 1.0 if m == 1 else 1 - sum(c * math.log(c) for c in texts.values()) / sum(texts.values()) / math.log(m)
            found = [x for c in below.get((host, style), ()) if (x := composite(c))]
            if not found:
                return content is not None and (content, content)
            parts = [c for c, _ in found] + ([content] if texts else [])
            presentation = 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in shapes.values())
            g = h.ATTENUATION ** len(parts)
            own = (1 - g) * presentation + g * sum(parts) / len(parts)
            return own, max([own] + [t for _, t in found])

        cuts[host] = {s for s in of if sum(of[s][False].values()) >= h.LEAST_PAGES and (x := composite(s)) and x[1] < h.LEAST_IMPORTANCE}
    return cuts


def brute(pages, prior=True):
    cuts = brute_cuts(pages, prior)
    return [h.main_text(source or "", frozenset(cuts[h.host_of(url)]), prior) for url, source in pages]


def site(n=40, host="t.org"):
    menu = "".join(f"<li><a href='/{i}'>Part {i}</a></li>" for i in range(6))
    page = lambda i: f"<html><head><title>x</title></head><body><div class=u1><ul>{menu}</ul></div><div class=u2><h4>Most read</h4><p>The same three lines</p></div><div class=u3><h2>Heading {i}</h2><p>First words of {i}.</p><p>Other words {i * 7}.</p></div><div class=u4><span>All rights kept</span></div></body></html>"
    return [(f"http://{host}/{i}", page(i)) for i in range(n)]

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><header><h2>Site</h2></header>
<main><article id=a><header><h1>Title &amp;
 more</h1></header><p><b>One<br>two &lt;3 <i>x</i>y<p>Three&nbsp;four a < b</p><ul><li>l1<li>l2</ul>tail
<pre>a
 b</pre><table><tr><td>c1<td>c2<tr><td>d1</table><form><p>mail</p><input></form><aside>side</aside><div class="share-buttons">share</div>
<section class="comments"><article class="comment"><p>reader</p></article></section></article></main><footer>&copy; x</footer><p>after</body></html>"""


def test_blocks_of_a_page():
    assert h.main_text(PAGE).split("\n\n") == ["Title & more", "One two <3 xy", "Three four a < b", "l1", "l2", "tail", "a b", "c1 c2", "d1"]


def test_odd_markup():
    assert h.main_text("") == "" and h.main_text("plain text") == "plain text"
    assert h.main_text("<p>a<p>b</div></p>c") == "a\n\nb\n\nc"
    assert h.main_text("<article><p>a &#233; &unknown; <script>x") == "a é &unknown;"
    assert h.main_text('<p title="a > b" hidden>x</p><p>y<br/>z') == "y z"
    assert h.main_text("<p>" * 3000 + "x") == "x"
    assert h.main_text("<div>" * 3000 + "x <!-- open") == "x"
    assert h.main_text("<p>1 <2 and 3> 4</p") == "1 <2 and 3> 4"


def test_style_tree_cuts_what_a_site_repeats(spark):
    make = lambda i, main: f"<html><body><div class='top'>Welcome to the site</div>{'<article>' if main else '<div class=c>'}<p>Same first line</p><p>Own text {i}</p>{'</article>' if main else '</div>'}<div class=x>Made with care</div></body></html>"
    rows = [(i, "http://a.org/%d" % i, make(i, False), "k") for i in range(12)] + [(100 + i, "http://b.org/%d" % i, make(7, True), "k") for i in range(12)] + [(200, None, None, "k"), (201, "http://small.org/", make(1, False), "k")]
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Same first line\n\nOwn text 3" and got[3].n_chars == len(got[3].text)
    assert got[105].text == "Same first line\n\nOwn text 7"  # the marked article stays though all twelve pages show it
    assert got[200].text == "" and got[201].text.startswith("Welcome")
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_generated_pages_keep_their_article(spark):
    import re
    from html import unescape

    path = "/root/testdata/sf0.001/pages.parquet"
    got = {r.page_id: r.text for r in h.extract(spark.read.parquet(path)).collect()}
    for row in pq.read_table(path).to_pylist():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        want = "\n\n".join(t for x in re.split(r"</?(?:p|h1)>", article) if (t := " ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split())))
        assert got[row["page_id"]] == want


def test_the_tree_alone_finds_the_articles_of_a_site(spark):
    pages = site() + [(f"http://few.org/{i}", s) for i, (_, s) in enumerate(site(3))]
    df = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in h.extract(df, prior=False).collect()}
    for i in range(40):
        assert got[i].text == f"Heading {i}\n\nFirst words of {i}.\n\nOther words {i * 7}." and got[i].n_cut == 9 and got[i].n_prior == 0
    assert all(got[i].text.startswith("Part 0") and got[i].n_cut == 0 for i in range(40, 43))  # too few pages to judge by


def test_trees_against_brute_force(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    rows = [(i, "http://one.org/" if i % 3 else u, s) for i, u, s in rows] + [(10**6 + i, u, s) for i, (u, s) in enumerate(site(30, "one.org") + site(20))] + [(5, None, None), (6, "http://t.org", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for prior in (True, False):
        want = sorted(zip([r[0] for r in rows], brute([r[1:] for r in rows], prior), strict=True))
        assert sorted((r.page_id, r.text) for r in h.extract(df, prior=prior).collect()) == want


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(h, "BROADCAST", 0)
    df = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(site())], "page_id long, url string, html string")
    assert [r.text for r in h.extract(df, prior=False).orderBy("page_id").collect()] == brute(site(), False)


def test_deep_pages_take_linear_time():
    began = time.time()
    blocks, nodes = h.read_page("<div><form>" * 20_000 + "x")
    assert not [b for b in blocks if not b[2]] and len(nodes) == 40_001
    assert h.main_text("<p><table>" + "<div>" * 20_000 + "x") == "x" and time.time() - began < 2
