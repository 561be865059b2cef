import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import vectors as V


def column(spark, values, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "text,flag",
    [
        ("Sommaire", False),
        ("Voir la Table des matières ici", True),
        ("Intro ........ 12", True),
        ("Plain text without numbers here", False),
        ("Contents\nalpha beta gamma", False),
        ("a line of text\nanother line here\nChapter one 7", True),
        ("wait... then more text follows here", True),
        ("1. Introduction to things 15\nbody text one\nbody text two\nbody three\nbody four", True),
        (None, False),
    ],
)
def test_toc(spark, text, flag):
    assert column(spark, [text], T.is_toc) == [flag]


@pytest.mark.parametrize(
    "text,flag",
    [
        ("Table\u00a0des\u00a0mati\u00e8res ici", True),
        ("alpha page\u00a012\nbeta page\u00a013", True),
        ("alpha page x12\nbeta page y13\nplain words\nmore plain words\nand more", False),
        ("END OF PART 7", True),
        ("end of part 7 in words\nand another line", False),
        ("abc 12\nx....\nplain words here", True),
        ("a.9 and so on\nno z1234\nplain words here", False),
        ("line\u2028Title 7\nplain words here\nmore words\nand more", True),
        ("1, 2\u2028Title 7\nplain words here\nmore words\nand more", False),
    ],
)
def test_toc_white_space_and_lines(spark, text, flag):
    assert column(spark, [text], T.is_toc) == [flag]


def test_toc_label_decides(spark):
    frame = spark.createDataFrame([("plain text of a chunk", "document_index"), ("plain text of a chunk", "text"),
                                   ("Intro ........ 12", None)], "v string, label string")
    got = [r[0] for r in frame.select(T.is_toc(F.col("v"), F.col("label"))).collect()]
    assert got == [True, False, True]


@pytest.mark.parametrize(
    "html,markdown",
    [
        ("<h1>A</h1><h2>B</h2><p>caf&eacute; &#233; &#xE9; &hellip; &bogus; &amp;lt;</p><ul><li>x<li>y</ul>",
         "# A\n## B\ncaf\u00e9 \u00e9 \u00e9 \u2026 &bogus; &lt;\n- x\n- y"),
        ("<h3 class=a>T</h3><h6>six</h6>one<br>two", "### T\n###### six\none\ntwo"),
        ("see <a href='/x?a=1&amp;b=2'>this</a> and <a class=k href=/y>that</a>", "see [this](/x?a=1&b=2) and [that](/y)"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| 1 | 2 |"),
        ("<nav>menu</nav><script>var a='<p>';</script><style>p{}</style><!-- c --><b>x</b>&nbsp; y", "x y"),
        ("&#0;&#1114112;&#55296;", "&#0;&#1114112;&#55296;"),
        ("", ""), (None, None),
    ],
)
def test_html_to_markdown(spark, html, markdown):
    assert column(spark, [html], T.html_to_text) == [markdown]


def test_accents_beyond_the_basic_plane(spark):
    import sys

    high = [chr(c) for c in range(0x10000, sys.maxunicode + 1)
            if unicodedata.normalize("NFD", chr(c)) != chr(c)
            and sum(unicodedata.category(x) != "Mn" for x in unicodedata.normalize("NFD", chr(c))) == 1]
    want = ["".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn") for c in high]
    assert column(spark, high, T.normalize_text) == want


def test_normalize_is_nfd_without_marks(spark):
    texts = ["Élève ÀÇÜ ñ œ ß", "Ǖ ḉ ế Å", "Ὰ й Ё", "éà", "plain"]
    want = [
        "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        for t in texts
    ]
    assert column(spark, texts, T.normalize_text) == want


@pytest.mark.parametrize(
    "query,words",
    [
        ("C'est quoi un chantier de type D ?", ["type D", "chantier", "type"]),
        ("Catégorie IV et étape 2", ["categorie IV", "etape 2", "categorie", "etape"]),
        ("les types de permis", ["type S", "types", "permis"]),
        ("hi", []),
        ("prototype a", ["type A", "prototype"]),
    ],
)
def test_keywords(spark, query, words):
    assert column(spark, [query], T.extract_keywords) == [words]


@pytest.mark.parametrize(
    "query,title,boost",
    [
        ("C'est quoi un chantier de type D ?", "Chantier de type D", 0.15),
        ("C'est quoi un chantier de type D ?", "Chantier", 0.03),
        ("C'est quoi un chantier de type D ?", "Guide des permis", 0.0),
        ("Catégorie IV et étape 2", "Catégorie iv", 0.15),
        ("Catégorie IV et étape 2", "Chantier", 0.0),
        ("les types de permis", "Guide des permis", 0.03),
        ("hi", "hi", 0.0),
    ],
)
def test_title_boost(spark, query, title, boost):
    got = column(spark, [query], lambda c: T.title_boost(F.lit(title), T.extract_keywords(c)))
    assert got == [pytest.approx(boost)]


@pytest.mark.parametrize(
    "url,name",
    [
        ("https://example.com/docs/Guide Page.html", "Guide_Page_82c70e93.md"),
        ("https://docs.example.com/", "docs_example_com_604a2c3c.md"),
        ("https://example.com/a/b.tar.gz?x=1", "b_tar_gz_6fafc7b8.md"),
        ("https://example.com/" + "x" * 60, "x" * 50 + "_fb8713fe.md"),
    ],
)
def test_file_names(spark, url, name):
    assert column(spark, [url], T.url_to_filename) == [name]


def test_resolve_url(spark):
    base = "https://example.com:8080/a/b/page.html?q=1#top"
    cases = {
        "/x/y": "https://example.com:8080/x/y",
        "c.html": "https://example.com:8080/a/b/c.html",
        "../c?z=2": "https://example.com:8080/a/c?z=2",
        "./d/": "https://example.com:8080/a/b/d/",
        "../../../e": "https://example.com:8080/e",
        "..": "https://example.com:8080/a/",
        "//other.org/p": "https://other.org/p",
        "#part": "https://example.com:8080/a/b/page.html?q=1#part",
        "?n=3": "https://example.com:8080/a/b/page.html?n=3",
        "http://z.org/": "http://z.org/",
        "mailto:a@b.c": "mailto:a@b.c",
    }
    got = column(spark, list(cases), lambda c: T.resolve_url(F.lit(base), c))
    assert got == list(cases.values())


def test_titles(spark):
    cases = {
        "---\ntitle: My page\n---\n# Other": "My page",
        "---\ntitle: 'It is'\n---\nx": "It is",
        "---\ntitle: 2024\n---\n# Real": "Real",
        "---\ntitle: \n---\n# Real": "Real",
        "---\ntitle: never closed\n# Real": "Real",
        "one\n  # Spaced  \nthree": "Spaced",
        "\n" * 10 + "# Too late": "stem.v2",
        "## sub only": "stem.v2",
    }
    got = column(spark, list(cases), lambda c: T.extract_title(c, F.lit("/d/stem.v2.md")))
    assert got == list(cases.values())


def test_counts(spark):
    texts = ["a b\nc", "", " \n ", "one two three\n"]
    assert column(spark, texts, T.word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, T.line_count) == [len(t.split("\n")) for t in texts]
    assert column(spark, ["A" * 400], T.token_estimate) == [100]


def test_strip_is_unicode(spark):
    texts = ["　\x1c a  \x85", "b"]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]


def test_requests(spark):
    rows = [
        ("hello", None, None, None),
        (" \t", None, None, "message empty"),
        ("", None, None, "message missing"),
        ("x" * 10001, None, None, "message too long"),
        ("a <SCRIPT>", None, None, "message has script"),
        ("a", "s p", None, "session format"),
        ("a", "s" * 101, None, "session too long"),
        ("a", "ok_-1", "v/m:1.0-b", None),
        ("a", "ok", "bad model", "model format"),
        ("a", "ok", "m" * 51, "model too long"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, s string, o string, w string")
    got = frame.orderBy("i").select(T.message_error(F.col("m"), F.col("s"), F.col("o"))).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_fingerprint(spark):
    a, b = column(spark, ["x", "y"], lambda c: T.fingerprint(c, F.lit(3)))
    assert a == hashlib.sha256(b'{"f0":"x","f1":"3"}').hexdigest()[:16] and a != b


def test_html(spark):
    html = (
        "<html><head><title> T &amp; U </title><style>p{}</style></head><body><!-- c --><nav>menu</nav>"
        "<h1>Head</h1><p>One <b>two</b><br>three&nbsp;&lt;x&gt;</p><script>var a='</p>'</script></body></html>"
    )
    assert column(spark, [html], T.html_to_text) == ["# Head\nOne two\nthree <x>"]
    assert column(spark, [html], T.html_title) == ["T &amp; U"]
    assert column(spark, ["intro\n# First \n# Second"], T.page_title) == ["First"]


def test_vector_text(spark):
    frame = spark.createDataFrame([([1.0, -2.5, 0.1],)], "v array<float>")
    back = frame.select(V.encode_vector(F.col("v")).alias("t"), "v").select(
        "t", (V.decode_vector(F.col("t")) == F.col("v")).alias("same"))
    row = back.first()
    assert row["t"] == "[1.0,-2.5,0.1]" and row["same"]


def test_cosine_of_zero_is_null(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0, 1.0])], "a array<float>, z array<float>, b array<float>")
    row = frame.select(V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("b"))).first()
    assert row[0] is None and row[1] == pytest.approx(2**-0.5)
