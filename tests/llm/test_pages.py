import html
import re

import pytest

from speechgrid.llm import pages, queries

LONG = "A paragraph of the story that goes on for a while, with commas, names and one thought after another until its end."
MORE = "The second paragraph says more of the same, at about the same length, so that its ratio of text to tags is as high."


def plain(page):
    """The blocks of the one article element of a page of the supplied tables, by patterns alone."""
    body = re.search("<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(x for x in blocks if x)


@pytest.mark.parametrize("page,text", [
    ("", ""),
    ("   \n ", ""),
    ("no tags at all &amp; one &#x41;&nbsp;line", "no tags at all & one A line"),
    (f"<p>{LONG}<p>Short.<p>{MORE}", f"{LONG}\n\nShort.\n\n{MORE}"),
    # menus, notices, adverts, forms, comments and footers around and inside an article
    (f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><a href="/">Site</a> {LONG}</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
      <div class="cookie-notice"><p>{MORE}</p></div><main><article class="post comments-open"><header><h1>The title</h1></header><p>{LONG}</p><div class="ad">{MORE}</div><p>Is.</p><form><p>{LONG}</p><input name=x></form>
      <ul><li>First point</li><li>Second &lt;point&gt;</li></ul><p>{MORE}<footer>By someone</footer></article><section id="comments"><p>{LONG}</p></section></main><aside>{LONG}</aside><footer>&copy; {LONG}</footer></body></html>""",
     f"The title\n\n{LONG}\n\nIs.\n\nFirst point\n\nSecond <point>\n\n{MORE}"),
    # no article element: the region is chosen by ratios; siblings and headings come along
    (f"""<body><div id=top><a href=1>Home</a> <a href=2>News</a></div><table><tr><td><a href=3>x</a></td></tr></table><div id=c><h2>Title</h2><div><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></div></div>
      <div><a href=4>Imprint</a> | <a href=5>Terms</a></div></body>""", f"Title\n\n{LONG}\n\nYes.\n\n{MORE}"),
    # a page that is one form
    (f"<form id=all><div class=menu><p>{LONG}</p></div><article><p>{MORE}</p></article></form>", MORE),
    # scripts with markup in strings, comments, references, line breaks
    (f"""<article><script>var t = "</p><p>no";</script><!-- <p>{LONG}</p> --><p>One<br>two<b>thr</b>ee &eacute;&#233; \t\n end</p><noscript>off</noscript><p style="display:none">hidden</p></article>""", "One two" + "three éé end"),
    # cut off in a tag, in a comment, in a reference, in the middle of an article
    (f"<article><p>{LONG}</p><p>{MORE}</p><div class=\"x", f"{LONG}\n\n{MORE}"),
    (f"<article><p>{LONG}</p><!-- {MORE}", LONG),
    (f"<article><p>{LONG} &am", f"{LONG} &am"),
    (f"<article><p>{LONG}</p><p title=\"open>{MORE}</p></article><footer>end</footer>", f"{LONG}\n\n{MORE}"),
    # odd declarations, stray end tags and comparison signs
    (f"<![foo bar]><article></b></div><p>a < b & c</p><![if !IE]><p>{LONG}</p><![endif]><?php x ?></article>", f"a < b & c\n\n{LONG}"),
    # a menu inside the article, links in running text
    (f"<article><p>{LONG} <a href=x>Linked words</a>.</p><div><div><a href=1>More one</a></div><div><a href=2>More two</a></div><div><a href=3>More three</a></div></div><p>{MORE}</p></article>",
     f"{LONG} Linked words.\n\n{MORE}"),
    # two articles are both kept
    (f"<main><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{MORE}</p></article></main>", f"A\n\n{LONG}\n\nB\n\n{MORE}"),
    (f"<article><table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table><pre>x\n  y</pre><p>{LONG}</article>", f"a b\n\nc d\n\nx y\n\n{LONG}"),
])
def test_page(page, text):
    assert pages.main_text(page) == text


def test_every_cut_of_a_page_ends():
    page = f"<html><head><title>T</title><body><nav><a href='x'>y</a></nav><article><h1>T &amp; U</h1><p class=\"a\">{LONG}</p><!-- c --><script>x</script></article>"
    whole = pages.main_text(page)
    for k in range(len(page)):
        for block in filter(None, pages.main_text(page[:k]).split("\n\n")):
            assert k < page.index("<article>") + 9 or "&" in block or block.rstrip(" <") in whole, page[:k]


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(pages.smoothed(np.full(7, 3.0)), 3) and np.allclose(pages.smoothed(np.array([1.0, 5.0]), 0), [1, 5])
    x = pages.smoothed(np.array([0, 0, 9.0, 0, 0]))
    assert x.argmax() == 2 and np.allclose(x, x[::-1]) and x[0] > 0
    assert pages.threshold(np.array([1.0, 1, 1, 100, 100])) == 50 and pages.threshold(np.zeros(4)) == 0 == pages.threshold(np.zeros(0))


def test_table_of_pages(spark):
    rows = [(1, None, "u", 5), (None, f"<p>{LONG}", None, 6), (3, "", "v", 7), (3, "", "v", 7), (4, "<article>" + f"<div><b><p>{LONG}" * 20_000, "w", 8), (5, "<" * 100_000, "x", 9), (6, "&" * 100_000, "y", 1), (7, "<a " * 50_000 + ">z", "z", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int").selectExpr("*", "'clash' AS text")
    got = sorted(((r.page_id or 0, r.url or "", r.n_chars, len(r.text)) for r in pages.extract_main(df).collect()))
    assert [g[0] for g in got] == [0, 1, 3, 3, 4, 5, 6, 7] and all(g[2] == g[3] for g in got)
    assert got[0][2] == len(LONG) and got[4][2] == 20_000 * (len(LONG) + 2) - 2 and got[5][2] == 100_000 == got[6][2]
    assert pages.extract_main(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_on_pages(spark, sf):
    path = f"/root/testdata/sf{sf}"
    want = {(r.page_id, r.url, plain(r.html)) for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    assert {(r.page_id, r.url, r.text) for r in queries.QUERIES["op11_main_text"](spark, path).collect()} == want
