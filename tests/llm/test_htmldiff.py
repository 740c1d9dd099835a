import random

from pyspark.sql import functions as F

from folioforge.llm import htmldiff


def length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    for seed in range(1500):
        r = random.Random(seed)
        k = r.choice([2, 3, 6, 20])
        a, b = ([r.randrange(k) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = htmldiff.shared_lines(a, b)
        it = iter(b)
        assert got == sorted(set(got)) and len(got) == length(a, b) and all(a[i] in it for i in got)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav><!-- ad <p>no</p> --><div class="ad">buy</div><div id="cookie-notice"><p>ok?</p></div>
<main><article><header><h1>The &amp; title</h1></header><p class=ad>buy<p>Real  text
of <b>one</b> para&shy;graph<br>more &lt;b&gt;<form><p>q</p></form><aside>side</aside><ul><li>one<li>two</ul>
<div class="comments"><article><p>reader</p></article></div><p>end &am</article></main><footer>foot</footer></body"""


def test_blocks():
    whole, lines = htmldiff.chosen(htmldiff.blocks(PAGE))
    assert whole and lines == ["The & title", "Real text of one para­graph more <b>", "one", "two", "end &am"]
    for cut in range(len(PAGE)):
        htmldiff.blocks(PAGE[:cut])
    page = '<body><div id="sidebar"><div>x</div></div><div class="post-content"><div><p>one</p></div><div class="cookieBar">c</div><p>two</p></div><div>tail</div></body>'
    assert htmldiff.chosen(htmldiff.blocks(page)) == (True, ["one", "two"])
    assert htmldiff.blocks("a < b <3 <p>x<") == [(0, "a < b <3"), (0, "x<")]


def test_nothing_but_boilerplate_goes_inside_an_article():
    inside = '<p>a</p><section id="related-work"><p>b</p></section><div class="alert alert-info">c</div><p>The <label>lab</label> z <noscript>n</noscript><object>o</object></p><div class="toc">d</div><div class="comments">r</div><div class="ad-slot">s</div>'
    want = ["a", "b", "c", "The lab z no", "d"]
    for page in (f"<article>{inside}</article>", f"<main><header>h</header>{inside}</main>", f"<article class=card><p>teaser</p></article><main>{inside}</main>", f"<main><article>{inside}</article><p>x</p></main>"):
        lines = htmldiff.chosen(htmldiff.blocks(page))[1]
        assert lines == (["h"] * ("<header>" in page) + want), page


def plain_lines(page):
    """What is in article elements, by splitting at tags: enough for pages as these tables have them."""
    import html
    import re

    out = []
    for article in re.findall(r"(?s)<article>(.*?)</article>", re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page or "")):
        for part in re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|blockquote|pre|section|figure|figcaption|header)\b[^>]*>", re.sub(r"(?s)<(form|aside|nav|footer)\b.*?</\1>|<div class=\"(?:ad|comments?)\">.*?</div>", "<p>", article)):
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith(("<br", "<td", "<th", "</td", "</th")) else "", part)).split())
            if text:
                out.append(text)
    return out


def test_query_against_plain_splitting(spark):
    from folioforge.llm import registry

    from ..conftest import DATA

    for sf in ("sf0.001", "sf0.01"):
        pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/{sf}/pages.parquet").collect()}
        got = registry.QUERIES["op4_html_extraction"](spark, f"{DATA}/{sf}").collect()
        assert len(got) == len(pages)
        for r in got:
            assert r["text"].split("\n") == plain_lines(pages[r["page_id"]]), r["page_id"]
            assert r["n_chars"] == len(r["text"])


def slow_difference(pages):
    """Each page without a container against every other page of its host that isn't its copy."""
    from urllib.parse import urlsplit

    parsed = []
    for i, url, page in pages:
        whole, lines = htmldiff.chosen(htmldiff.blocks(page or ""))
        u = urlsplit(url or "")
        parsed.append((i, u.netloc, u.path, whole or not lines, lines))
    out = []
    for i, host, path, whole, lines in parsed:
        rest = lines
        if not whole:
            distinct = {}
            for _, h, p, _, t in parsed:
                if h == host:
                    distinct[tuple(t)] = min(p, distinct.get(tuple(t), p))
            order = sorted((p, t) for t, p in distinct.items())
            at = order.index((distinct[tuple(lines)], tuple(lines)))
            near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
            if near:
                own = order[at][0]
                best = max(near, key=lambda x: len(__import__("os").path.commonprefix([x[0], own])))
                number = {t: k for k, t in enumerate({*lines, *best[1]})}
                gone = set(htmldiff.shared_lines([number[t] for t in lines], [number[t] for t in best[1]]))
                rest = [t for k, t in enumerate(lines) if k not in gone]
        out.append((i, "\n".join(rest)))
    return sorted(out)


def test_differencing_against_a_slow_one(spark):
    r = random.Random(2)
    pages = []
    for i in range(120):
        own = "".join(f"<p>{r.choice(['menu', 'about', 'legal', f'text {i} {k}', 'shared news'])}</p>" for k in range(r.randint(0, 6)))
        pages.append((i, f"http://h{i % 3}.example/{r.choice('ab')}/{i:03d}", f"<body><div>Home {i % 3}</div>{own}<div>All rights</div></body>" if i % 9 else PAGE))
    pages += [pages[10], pages[10], (500, "http://h1.example/z/copy", pages[10][2]), (501, "http://lone.example/x", pages[4][2]), (501, "http://lone.example/x", pages[4][2])]
    got = htmldiff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert sorted((x["page_id"], x["text"]) for x in got) == slow_difference(pages)
    assert {x["text"] for x in got if x["page_id"] == 501} == {"\n".join(htmldiff.chosen(htmldiff.blocks(pages[4][2]))[1])}


def test_differencing_of_pages_without_an_article(spark):
    body = lambda x: f"<body><div>Home of things</div><p>{x}</p><div>All rights</div></body>"
    pages = [(i, f"http://h.example/a/{i:03d}", body(f"story {i}")) for i in range(200)]
    pages += [(1000, "http://alone.example/x", body("single")), (1001, None, None), (1002, "http://[bad", body("bad")), (1003, "http://h.example/b", PAGE), (1004, "http://e.example/", ""), (1003, "http://h.example/b", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'x' AS lines", "'x' AS k0").repartition(7)
    got = {r["page_id"]: r for r in htmldiff.main_text(df).collect()}
    assert all(got[i]["text"] == f"story {i}" for i in range(200))
    assert got[1000]["text"] == "Home of things\nsingle\nAll rights"
    assert got[1001]["text"] == "" and got[1001]["n_chars"] == 0
    assert got[1003]["text"].startswith("The & title\n") and got[1003]["n_chars"] == len(got[1003]["text"])
    assert htmldiff.main_text(df).count() == len(pages)
    assert htmldiff.main_text(df.where(F.lit(False))).count() == 0
