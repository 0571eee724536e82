"""Operators over pages and vectors against brute-force versions, edge rows included."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import html_text, topk, url_filter
from tests.llm import cases

# exact top-k


def best(rows, every, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked: dict = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def vectors():
    import random

    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(20)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(500, None), (520, [0.1, None]), (540, [float("nan")] * 20), (560, [float("inf")] * 20), (None, [0.5] * 20)]
    rows += [(580, []), (600, [0.25]), (620, [1.0] * 30), (640, [-1e-12] * 20), (660, [0.0] * 20)]
    rows += [(680, [0.1] * 20), (680, [0.2] * 20), (681, [0.1] * 20), (681, [0.1] * 20)]  # repeated ids
    return rows


@pytest.mark.parametrize("cells", [(512, 4096), (7, 50)])
def test_top_k(spark, cells):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit("x"))
    got = topk.top_k(df, "vec_id", "embedding", 20, 20, *cells).collect()
    assert sorted(map(tuple, got)) == best(rows, 20, 20)
    assert topk.top_k(df.limit(0), "vec_id", "embedding").count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk.top_k(few, "vec_id", "embedding").collect())) == best(rows[:3], 20, 20)


def test_top_k_large_components(spark):
    rows = [(0, [3e12, 1.0]), (1, [1.5e2, 1.0]), (2, [1.5e2, 2.0]), (3, [1.5e2, 1.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert sorted(map(tuple, got)) == best(rows, 20, 20)


# url filters


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:at], rest[at:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return cases.lower(host), rest[:end]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme/en/7", "http://", "://x.com/en/1", "HTTP://WWW.Example.COM/en/71?x=/de/", "http://example.com/en/7", "http://examplex.com/en/7"]
    urls += ["http://com/en/", "http://notcom/en/", "http://a.net/de/8", "http://a.example.net/de/8#/x", "http://a.org/es", "http://a.org/es/", "ftp://a.b://c/en/d"]
    urls += ["http://q.org?x=/es/", "http://q.org#://z.com/en/", "http://ä.com/en/Ä", "http://a.com/en/1\n2", "http://a.org:80/es/1", "http://h.com/" + "a/" * 3000]
    urls += [f"http://bulk.org/{lang}/{i}" for lang in ("es", "fr") for i in range(60)] + [f"http://wide.net/p{chr(97 + i % 26)}{i // 26}x/y" for i in range(120)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, None)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    got = url_filter.filter_urls(df, "page_id", "url", url_filter.RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = parts(urls[r.page_id]) if r.page_id is not None else ("", "")
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    templates = {r.template for r in got if r.host == "bulk.org"}
    assert 1 < len(templates) <= 3 and {r.verdict for r in got if r.host == "bulk.org" and r.path.startswith("/fr")} == {"block"}  # all that is known of the host is bad
    assert len({r.template for r in got if r.host == "wide.net"}) <= 3
    assert url_filter.filter_urls(df.limit(0), "page_id", "url", url_filter.RULES).count() == 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    asked = [("a.com", "/en/1", "block"), ("example.com", "/en/71", "allow"), ("example.com", "/en/1", "block"), ("a.net", "/de/8", "allow"), ("net", "/de/", "allow")]
    asked += [("www.example.net", "/de/8", "block"), ("example.net", "/de/7", "allow"), ("a.org", "/es/1", "block")]
    spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(asked)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in url_filter.op9_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i].verdict for i in range(len(asked))] == [v for _, _, v in asked]
    assert [got[i].rule for i in (0, 1, 3, 5, 7)] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/"]


def test_url_labels_reject_a_template(spark):
    rows = [(i, f"http://s.io/spam/{i}", i >= 30 and None) for i in range(60)] + [(100 + i, f"http://s.io/good/{i}", True) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, fine boolean")
    got = url_filter.filter_urls(df, "page_id", "url", (), F.col("fine")).collect()
    assert {r.verdict for r in got if r.path.startswith("/spam")} == {"block"}
    assert {r.verdict for r in got if r.path.startswith("/good")} == {"allow"}


def test_url_purity_comes_from_above(spark):
    """Branches without labels take after their node and host; a host without labels is allowed; deep branches stay apart."""
    rows = [(f"http://a.bad.io/x/{i}/p", False) for i in range(40)] + [(f"http://fine.net/x/{i}/p", True) for i in range(40)]
    rows += [(f"http://deep.net/a/b/c/d/e/{kind}/{i}", kind == "good") for kind in ("good", "spam") for i in range(40)]
    open_ = ["http://a.bad.io/y/1", "http://b.bad.io/z", "http://fine.net/y/1", "http://c.fine.net/q", "http://deep.net/a/b/c/d/e/spam/99", "http://deep.net/a/b/c/d/e/good/99"]
    rows += [(u, None) for u in open_]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id long, url string, fine boolean")
    got = {rows[r.page_id][0]: r for r in url_filter.filter_urls(df, "page_id", "url", (), F.col("fine")).collect()}
    assert [got[u].verdict for u in open_] == ["block", "allow", "allow", "allow", "block", "allow"]
    assert got[open_[0]].purity < 0.5 < got[open_[1]].purity == url_filter.PRIOR


# html

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body class='nav'>"
    "<header><h2>Site</h2></header><nav><ul><li><a href=/a>menu</a></ul></nav><div class='cookie-notice'><p>We use cookies</p></div>"
    "<article><header><h1>The &amp; title</h1></header><p>First <b>bold</b>   text&nbsp;with\n a link <a href=x>here</a>.<p>Second&lt;p&gt; &#233;.</p>"
    "<div class=ad><p>Buy</p></div><form><p>Name</p><input></form><p>Ok.</p><section id='comments'><p>Nice one</p></section></article>"
    "<aside><p>Read this too</p></aside><footer>&copy; me</footer></body></html>"
)


def test_html_regions():
    assert html_text.main_text(PAGE) == "The & title\n\nFirst bold text with a link here.\n\nSecond<p> é.\n\nOk."
    assert html_text.main_text(PAGE[: PAGE.index("Ok.") + 3] + "<p cla") == "The & title\n\nFirst bold text with a link here.\n\nSecond<p> é.\n\nOk."
    plain = PAGE.replace("<article>", "<div id=x>").replace("</article>", "</div>").replace("First", "First of many words in a long paragraph, so that it is content,")
    assert "First of many words" in html_text.main_text(plain) and "menu" not in html_text.main_text(plain)
    post = "<div class=post><h1>T</h1><p>" + "words of a long paragraph " * 30 + "</p><p>Short.</p><p>ok</p></div>"
    page = f"<body><div><a href=/>Home</a> <a href=/x>News</a></div><div class=wrap>{post}<div class=sidebar><p>side</p></div></div><div id=footer>c</div></body>"
    assert html_text.main_text(page).startswith("T\n\nwords of") and html_text.main_text(page).endswith("paragraph\n\nShort.\n\nok")
    for empty in ("", " ", "<nav>x</nav>", "<script>x", "<", "<!-- x", "</p>", "<article></article>"):
        assert html_text.main_text(empty) in ("", "<")


def test_html_marked_elements_that_are_not_the_body():
    texts = [f"Paragraph {i} of the body with many words that are its text and go on for a good while." for i in range(8)]
    body, nav = "".join(f"<p>{t}</p>" for t in texts), "<nav><a href=/>Home</a></nav>"
    card = "<div><article><h3>Another</h3><p>A summary of another story, long enough to be of the high cluster of lines.</p></article></div>"
    for page in (f"<body>{nav}<div>{body}</div>{card}</body>", f"<body>{nav}<main>{body}</main>{card}</body>", f"<body>{card}{nav}<div><div>{body}</div></div></body>"):
        assert html_text.main_text(page) == "\n\n".join(texts)
    split = "".join(f"<article><p>{t}</p></article>" for t in texts)
    for page in (f"<body>{nav}<div>{split}</div><div id=footer>c</div></body>", f"<body><div><a href=/>Home</a></div>{split}</body>", f"<body>{nav}<main>{split}</main></body>"):
        assert html_text.main_text(page) == "\n\n".join(texts)


def test_html_rows(spark):
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 20_000 + "x" * 200_000), (4, "x", "<![CDATA[x]]><p>y"), (5, "y", "\x00<p>z&#0;")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = html_text.extract(df, "page_id", "url", "html").collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id) == sorted(
        (i, u, html_text.main_text(h or ""), len(html_text.main_text(h or ""))) for i, u, h in pages if i
    ) or len(got) == len(pages)
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(pages)
    assert html_text.extract(df.limit(0), "page_id", "url", "html").count() == 0


def test_html_of_real_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert html_text.main_text(r.html) == "\n\n".join(b for b in blocks if b)
