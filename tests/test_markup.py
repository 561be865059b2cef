"""Markdown by a tag stack: random nested pages against a plain walk of their tree, hand-made and long cases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docmill.functions.markup import DEPTH, html_to_markdown, markdown_of
from docmill.functions.text import html_to_text

MB = 1 << 20


def blocks(r, depth):
    """Random tree: lists of (kind, content)."""
    kinds = ["p", "h", "pre", "table"] + ["ul", "ol", "quote", "div"] * (depth > 0)
    return [node(r, r.choice(kinds), depth - 1) for _ in range(r.randint(1, 3))]


def node(r, kind, depth):
    words = " ".join(r.choice(["alpha", "beta", "x", "y1", "&lt;"]) for _ in range(r.randint(1, 4)))
    if kind in ("ul", "ol"):
        return kind, [[("text", words), *(blocks(r, depth) if r.random() < 0.5 else [])] for _ in range(r.randint(1, 3))]
    if kind in ("quote", "div"):
        return kind, blocks(r, depth)
    if kind == "table":
        wide = r.randint(1, 3)
        return kind, [[f"c{r.randint(0, 9)} d" for _ in range(wide)] for _ in range(r.randint(1, 3))]
    return kind, words


def html(tree, r):
    out = []
    for kind, content in tree:
        end = lambda tag: f"</{tag}>" if r.random() < 0.6 else ""
        if kind == "text":
            out.append(content)
        elif kind == "p":
            out.append(f"<p class='a>b'>{content.replace(' ', '  ' + chr(10))}{end('p')}")
        elif kind == "h":
            out.append(f"<h2>{content}</h2>")
        elif kind == "pre":
            out.append(f"<pre>{content}\n  more</pre>")
        elif kind == "table":
            rows = (f"<tr>{''.join(f'<td>{c}{end("td")}' for c in row)}{end('tr')}" for row in content)
            out.append(f"<table>{''.join(rows)}</table>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>{''.join(f'<LI>{html(item, r)}{end("li")}' for item in content)}</{kind}>")
        else:
            tag = "blockquote" if kind == "quote" else "div"
            out.append(f"<{tag}>{html(content, r)}</{tag}>")
    return "".join(out)


def lines(tree, item=False):
    """(line, stands with the line before it if that is of this kind: in an item, in one block)."""
    out = []
    for kind, content in tree:
        plain = content.replace("&lt;", "<") if isinstance(content, str) else None
        if kind in ("text", "p"):
            out.append((plain, "item" if item else None))
        elif kind == "h":
            out.append((f"## {plain}", None))
        elif kind == "pre":
            out += [("```", None), *((x, "same") for x in (*plain.split("\n"), "  more", "```"))]
        elif kind == "table":
            rows = [f"| {' | '.join(row)} |" for row in content]
            rows.insert(1, "|" + " --- |" * len(content[0]))
            out += [(x, "same" if i else None) for i, x in enumerate(rows)]
        elif kind in ("ul", "ol"):
            for n, held in enumerate(content, 1):
                first = f"{n}. " if kind == "ol" else "- "
                inner = lines(held, True)
                out += [((first if i == 0 else " " * len(first)) + x, how) for i, (x, how) in enumerate(inner)]
        else:
            out += [("> " * (kind == "quote") + x, how) for x, how in lines(content, item)]
    return out


def plain_walk(tree):
    out, before = [], None
    for line, how in lines(tree):
        if out and not (how == "same" or (how == "item" and before == "item")):
            out.append("")
        out.append(line.rstrip())
        before = how
    return "\n".join(out)


def test_nested_pages_equal_a_plain_walk():
    r = random.Random(7)
    for _ in range(1_500):
        tree = blocks(r, r.randint(0, 4))
        page = html(tree, r)
        assert markdown_of(page) == plain_walk(tree), page


@pytest.mark.parametrize("page, markdown", [
    ("<ul><li>a<ul><li>b<ol start=3><li>c<li>d</ol></ul><li>e</ul>f", "- a\n  - b\n    3. c\n    4. d\n- e\n\nf"),
    ("<p>a <b>bold <i>both</i></b><a href='u?x=1&amp;y'> link\n<b>b</b></a> c", "a **bold *both*** [link **b**](u?x=1&y) c"),
    ("<a href=/x/>slash</a> <a name=n>anchor</a> <a href=''>none</a>", "[slash](/x/) anchor none"),
    ("<a href=1>one<a href=2>two", "[one](1)[two](2)"),
    ("<a href=u><h2>T</h2><p>x</p></a>", "## [T](u)\n\n[x](u)"),
    ("<pre><code>if a:\n  b&lt;`c`</code></pre>", "```\nif a:\n  b<`c`\n```"),
    ("<pre>```\nx</pre>", "````\n```\nx\n````"),
    ("<p>a<br>b<br><br>c<p>d", "a\nb\nc\n\nd"),
    ("<table><caption>C</caption><tr><th>a|b<td><p>x<p>y<table><tr><td>1<td>2</table>z<tr><td>q</table>t",
     "C\n\n| a\\|b | x y 1 2 z |\n| --- | --- |\n| q |\n\nt"),
    ("<table><td>a<tr><td>b</table>", "| a |\n| --- |\n| b |"),
    ("<head><title>t</title><link><style>s</style></head><body><nav><ul><li>m</ul></nav><!-- c --><p>x<script>'</p>'</script>", "x"),
    ("<div>a<nav>m</nav>b</div>", "a\n\nb"),
    ("<nav>never closed <p>text", "never closed\n\ntext"),
    ("<h1>a</h1>x<hr>y<img src=i.png alt='an &quot;i&quot;'><img src=j>", '# a\n\nx\n\n---\n\ny![an "i"](i.png)'),
    ("</p></li></table>a</div><td>b<li>c", "a\n\nb\n\n- c"),
    ("a&nbsp;&amp;&#233;&bogus; < b <3", "a &é&bogus; < b <3"),
    ("", ""), ("<p> </p>", ""), ("<b></b><ul><li></ul>", ""),
])
def test_pages(page, markdown):
    assert markdown_of(page) == markdown


@pytest.mark.parametrize("piece", [
    "<a href=\"x\">", "<a href=x>t", "<div ", "<!-- ", "<script>", "<p>text ", "<", "<ul><li>", "<ul><li>x", "</a>", "<nav>x</nav>", "<nav>",
    "<b>x", "<b>x</b>", "<br>", " <br>", "x<br>", "<table><tr><td>", "<table><tr><td>x", "<td>x", "<blockquote>x", "<pre>x", "<pre>x</pre>",
    "<h1>x", "<svg>", "<select><option>x", "<x a='y=\"", "<img alt=a src=b>", "<ol><li><p>x</ol>", "`", "<code>`</code>", "<i>x</b>", "<a>x<p>",
])
def test_a_megabyte_of_broken_markup(piece):
    begun = time.time()
    markdown_of("<p>first</p>" + piece * (MB // len(piece)))
    assert time.time() - begun < 20


def test_deep_nesting_keeps_all_text():
    words = [f"w{i}" for i in range(DEPTH * 3)]
    for tag in ("div", "ul><li", "blockquote", "b", "table><tr><td", "q"):
        found = re.findall(r"\w+", markdown_of("".join(f"<{tag}>{w} " for w in words)))
        assert found == words


def test_column(spark):
    rows = [(1, "<ul><li>a<ul><li>b</ul></ul>"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, "id long, html string").select("id", html_to_markdown("html").alias("m"))
    assert [tuple(r) for r in frame.orderBy("id").collect()] == [(1, "- a\n  - b"), (2, None), (3, "")]


def test_words_of_the_table(spark, root):
    pages = spark.read.parquet(f"{root}/pages.parquet").select(html_to_markdown("html").alias("m"), html_to_text(F.col("html")).alias("t"))
    for r in pages.collect():
        assert re.findall(r"\w+", r["m"]) == re.findall(r"\w+", r["t"])
