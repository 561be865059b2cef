import re
import time

import pytest

from docmill.llm.op5_blocks import DEPTH, Features, Labeller, blocks_of, extract, joined, main_texts, named_purpose, train, train_on

# Blocks and text of one page, written by hand.
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>
<header class="site"><a href=/>Home</a></header><!-- <p>hidden</p> --><nav><ul><li><a href="/a">A &amp; B</a><li>C</ul></nav>
<article><h1>Caf&eacute;  &#8211; <i>x</i>y</h1><p>One<br>two <b>three<p>Four &lt;5&gt;&nbsp;six<script>var a="</p>";</script></p>
<table><tr><td>cell<td>next</table></article><div class="comments"><p>Nice</p></div><footer>end</footer>"""


def test_blocks_and_paths():
    found = blocks_of(PAGE)
    assert [b.text for b in found] == [
        "Home", "A & B", "C", "Café – xy", "One two three", "Four <5> six", "cell", "next", "Nice", "end",
    ]
    assert [b.path[-1][0] for b in found] == ["header", "li", "li", "h1", "p", "p", "td", "td", "p", "footer"]
    assert [named_purpose(b.path) for b in found] == [0, 0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert found[1].linked == len("A &amp; B") and found[2].linked == 0


@pytest.mark.parametrize("page", ["<p", "a<b", "<div class='x>y", "</p></div>", "<!-- open", "<script>x", "<a href=\"x>y</a>"])
def test_broken_markup(page):
    blocks_of(page)


@pytest.mark.parametrize("page, texts", [
    ('<svg class="i"/><article><p>Text</p></article>', ["Text"]),
    ("<object data=x /><p>a</p><object><p>b</p></object><p>c</p>", ["a", "c"]),
    ("<select><option>1<option>2<p>Text</p>", ["Text"]),
    ("<p>a <svg><svg><text>x</text></svg>y</svg> b</p>", ["a b"]),
    ("<p>a</p><svg><p>b</p>", ["a", "b"]),
    ("<canvas><p>a</p><noscript><p>b</p><title>c<p>d</p>", ["a", "b", "c", "d"]),
    ("<p>a</p><script>if (a<b) '</p>'", ["a"]),
    ("<script>'<svg>'</script><p>a <svg>x</svg>b</p>", ["a b"]),
    ('<p title="x > y">a</p><p title=\'x" > <b>z</b>\'>b</p>', ["a", "b"]),
    ("<p title='x>a</p><p>b</p>", ["a", "b"]),
    ("a < b <3 <> c", ["a < b <3 <> c"]),
    ("<!doctype html><?xml x?><p>a</p><!-- b", ["a"]),
])
def test_elements_without_text(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


@pytest.mark.parametrize("piece", [
    "<div ", "<div><p>", "<div>x", "<a href='x'>y", "<svg>", "<svg ", "<select>", "<title>", "<script", "<!-- ", "<", "</p>", "<x a='y=\"",
    "<li><div>x", "<table><tr><td>x", "<object/>", "<option>x", "&amp", "</div><div>", "<b>", "<!x",
])
def test_long_broken_pages_take_linear_time(piece):
    begun = time.time()
    blocks = blocks_of("<p>first</p>" + piece * ((1 << 20) // len(piece)) + "<p>last</p>")
    assert blocks[0].text == "first" and time.time() - begun < 20
    features = Features()
    for b in blocks[:: len(blocks) // 50 + 1]:
        assert len(b.path) <= DEPTH and len(features.path_slots(b.path)) < 1_000


def test_gradients_match_differences():
    import numpy as np

    labeller, features = Labeller(), Features()
    pages = [blocks_of(PAGE), blocks_of("<p>a b</p><p>c</p>")]
    parts, lengths = joined([features(p) for p in pages])
    labels = np.arange(lengths.sum()) % 2
    weights = np.ones(lengths.sum())
    labeller.p = {k: v.astype(np.float64) for k, v in labeller.p.items()}

    def loss():
        s = labeller.run(labeller.inputs(parts), lengths)
        return float((np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - s * labels).sum() / weights.sum())

    grads = labeller.gradients(parts, lengths, labels, weights)
    random = np.random.default_rng(0)
    for name, grad in grads.items():
        for at in random.choice(np.flatnonzero(grad), 4):
            flat = labeller.p[name].reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-3
            up = loss()
            flat[at] = old - 1e-3
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-3 - grad.reshape(-1)[at]) < 2e-3 * max(1, abs(grad.reshape(-1)[at]))


@pytest.fixture(scope="module")
def labeller(spark, root):
    return train(spark.read.parquet(f"{root}/pages.parquet"))


def test_articles_of_the_table(spark, root, labeller):
    """The article's paragraphs, cut out of the known template by patterns."""
    import html

    pages = spark.read.parquet(f"{root}/pages.parquet")
    found = {r["page_id"]: r for r in extract(pages, labeller).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n\n".join(x for x in parts if x)
        assert found[row["page_id"]]["text"] == expected
        assert found[row["page_id"]]["n_chars"] == len(expected)


def test_other_layouts(labeller):
    """Pages without semantic elements: containers with telling or no names around the same text."""
    body = "<h1>Onder the erin</h1><p>Erin ththat of the onan, thing erer. Thhe ouer and that.</p><p>Reed ther on, er.</p>"
    around = (
        '<div id="cookie-notice">We use cookies <button>OK</button></div><ul class="menu"><li><a href=/>Home</a>'
        '<li><a href=/b>News</a></ul>{}<div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One thing</a></ul></div>'
        '<div id=comments><h3>3 comments</h3><div class="comment"><p>I think so.</p></div></div>'
        '<form><label>Email</label><input></form><div class="footer">&copy; 2020</div>'
    )
    expected = "Onder the erin\n\nErin ththat of the onan, thing erer. Thhe ouer and that.\n\nReed ther on, er."
    for outer in ('<div class="post-content">{}</div>', "<main>{}</main>", '<div class="story">{}</div>'):
        assert main_texts([around.format(outer.format(body))], labeller, Features()) == [expected], outer


def test_awkward_pages(spark, labeller):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "<article>" + "<p>long text here" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "1 as n_chars")
    found = extract(pages, labeller).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in found if r["page_id"] in (1, 2)) == [
        (1, "", 0), (1, "", 0), (2, "", 0)
    ]
    assert len(found) == 5
    assert [r["n_chars"] for r in found if r["page_id"] == 3] == [20_000 * 16 - 2]
    assert extract(pages.where("1 = 0"), labeller).count() == 0
    assert train(pages.where("1 = 0")) is None and train_on(["<div>no names</div>"]) is None
    assert main_texts(["<article><p>a</p></article><p>b"], None, Features()) == ["a"]
