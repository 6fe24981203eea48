"""Blocks by hand, gradients against differences, held-out accuracy, and odd inputs."""

import html
import os
import re

import numpy as np
import pytest

from driftmap.llm import html_extraction as s
from driftmap.llm.html_blocks import parse
from driftmap.llm.page_layouts import labelled_pages

FOLDER = "/root/testdata/sf0.01"


def texts(source):
    return [b.text for b in parse(source).blocks]


@pytest.mark.parametrize(
    "source, want",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<b>b</b>c<br>d</p>e", ["abc d", "e"]),
        ("<p>one<p>two<div>three", ["one", "two", "three"]),
        ("x<script>var t='</p>';a<b</script>y<style>p{}</style>z", ["x", "y", "z"]),
        ("a<!-- b <p> --> c<!-- open <p>d", ["a c"]),
        ("1 < 2 &amp; 3 &gt; 2 &copy;&#65;&#x42; &bogus; &am", ["1 < 2 & 3 > 2 ©AB &bogus; &am"]),
        ("<p title='a > b' class=x>t&nbsp;&nbsp;u</p>", ["t u"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("</div></p>a<unknown>b</unknown>", ["ab"]),
        ("<p>a<div class='open", ["a"]),
        ("<script>never closed <p>a", []),
        ("<TITLE>t</TITLE><BODY><P>A</P></BODY>", ["A"]),
    ],
)
def test_blocks(source, want):
    assert texts(source) == want


def test_paths_and_links():
    page = parse("<body><div class='siteNav main-menu' id=top><ul><li><a href=x>Home</a> now</ul></div><article><p>t</article>")
    first, second = (set(page.paths[b.path]) for b in page.blocks)
    assert {"div", ".site", ".nav", ".main", ".menu", ".top", "li^0"} <= first and page.blocks[0].linked == 4
    assert {"article", "p^0", "article^1"} <= second and "div" not in second and page.blocks[1].linked == 0


def test_deep_and_broken_pages_take_linear_time():
    assert len(texts("<div>" * 20_000 + "<p>x" * 20_000)) == 20_000
    assert texts("<a b='" * 20_000) == []
    assert texts("<" * 100_000 + "p") != []
    assert len(texts("<!-- " * 50_000 + "x")) == 0


def test_gradients_match_differences():
    made = labelled_pages(3, 5)
    features, labels = s.Features([parse(x) for x, _ in made]), np.array([m for _, leaves in made for _, m in leaves])
    weights = s.initial(1)
    _, grads = s.gradients(features, labels, weights)
    rng = np.random.default_rng(2)
    for name in weights:
        way = np.where(grads[name] != 0, rng.standard_normal(weights[name].shape), 0).astype(np.float32)
        way /= np.linalg.norm(way)
        moved = [s.gradients(features, labels, weights | {name: weights[name] + e * way})[0] for e in (1e-2, -1e-2)]
        assert abs((moved[0] - moved[1]) / 2e-2 - float((grads[name] * way).sum())) < 3e-4, name


@pytest.fixture(scope="module")
def weights(spark):
    return s.trained(spark)


def test_held_out_layouts(weights):
    made = labelled_pages(300, 4711)
    labels = np.array([m for _, leaves in made for _, m in leaves])
    found = s.probabilities(s.Features([parse(x) for x, _ in made]), weights) >= 0.5
    assert (found == labels).mean() > 0.99


def by_hand(source):
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in blocks if x)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_pages(spark, weights):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r for r in s.op13_main_text(spark, FOLDER).collect()}
    right = [got[r.page_id].text == by_hand(r.html) for r in rows]
    assert len(got) == len(rows) and np.mean(right) > 0.99
    assert all(r.n_chars == len(r.text) and r.url for r in got.values())


PARTS = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>",
    "cookie": "<div class='cookie-banner'><p>We use cookies to improve this site.</p><button>OK</button></div>",
    "aside": "<aside class='sidebar'><h3>Related articles</h3><ul><li><a href='/c'>Another one</a></li></ul></aside>",
    "comments": "<section class='comments'><h3>3 comments</h3><div class='comment'><p>I think that this is not so, as all of us have seen before.</p></div></section>",
    "form": "<form action='/s'><label>Your email address</label><input><button>Subscribe</button></form>",
    "ad": "<div class='advert'><p>Buy now and save on all that you need for the garden.</p></div>",
    "footer": "<footer>&copy; 2024 example.com</footer>",
}
BODY = "<h1>A title of some words</h1><p>The first paragraph has a number of words, and it goes on for a while.</p><p>Short.</p><p>The last one is here, and it says as much as the first of them said.</p>"


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id='content'>{}</div>"])
def test_parts_of_pages(weights, outer):
    source = "<html><body>" + PARTS["cookie"] + PARTS["nav"] + PARTS["ad"] + outer.format(BODY) + PARTS["aside"] + PARTS["comments"] + PARTS["form"] + PARTS["footer"] + "</body></html>"
    page = parse(source)
    main = s.probabilities(s.Features([page]), weights) >= 0.5
    assert [b.text for b, m in zip(page.blocks, main, strict=True) if m] == texts(BODY)


def test_odd_rows(spark, weights):
    long = "<article>" + "".join(f"<p>word{i} and some more of it, here.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<nav><a href=x>Home</a></nav>"), (2, "v", f"<article>{BODY}</article>"), (3, None, long), (4, "w", "<article><p>" + "wörd " * 300_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as blocks")
    got = s.extract_text(df, weights).collect()
    assert sorted([(r.page_id or 0, r.url or "", r.n_chars) for r in got]) == sorted((i or 0, u or "", n) for (i, u, _), n in zip(rows, (0, 0, 0, len("\n".join(texts(BODY))), len("\n".join(texts(long))), 1_499_999), strict=True))
    assert s.extract_text(df.filter("false"), weights).collect() == []
    again = s.extract_text(df.repartition(5), weights).collect()
    assert sorted(again, key=repr) == sorted(got, key=repr)
