"""Inputs of a megabyte that once ended the session or took hours, and nested metadata."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import catalog, documents
from docmill.operators.chunking import chunk_sliding
from docmill.sources import files

MB = 1 << 20


def of(spark, text, column):
    begun = time.time()
    found = spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]
    assert time.time() - begun < 20
    return found


def test_keyword_list(spark):
    assert of(spark, f"['{'a' * MB}','b']", files.keyword_list) == ["a" * MB, "b"]
    many = "l'eau " * 150_000
    assert of(spark, f"['{many}', 'x']", files.keyword_list) == [many, "x"]
    assert of(spark, "['l'eau','d'or', '', 'a b']", files.keyword_list) == ["l'eau", "d'or", "", "a b"]


def test_frontmatter(spark):
    nested = "\n".join(f"  - item {i}" for i in range(60_000))
    found = of(spark, f"---\ntitle: x\nlist:\n{nested}\nend: 1\n---\nbody", T.frontmatter)
    assert found == {"title": "x", "list": nested.strip(), "end": "1"}
    many = "\n".join(f"k{i}: v{i}" for i in range(60_000))
    assert len(of(spark, f"---\n{many}\n---\n", T.frontmatter)) == 60_000
    assert of(spark, "---\na: 1\nb: 2\na: 3\n---\n", T.frontmatter) == {"a": "3", "b": "2"}


@pytest.mark.parametrize("piece", ['<a href="x">', "<div ", "<!-- ", "<script>", "<p>text ", "<", "<ul><li>", "</a>", "<nav>x</nav>"])
def test_markdown_of_unclosed_tags(spark, piece):
    of(spark, "<p>first</p>" + piece * (MB // len(piece)), T.html_to_text)


def test_markdown_keeps_its_rules(spark):
    html = (
        "<h1>T</h1><!-- c --><script>s</script><p>a <a class=b href='u?x=1'>link <b>bold</b></a> b</p><a name=n>anchor</a>"
        "<nav>menu</nav><ul><li>one<li>two</ul></a> open <a href=q>never closed <!-- nor this"
    )
    assert of(spark, html, T.html_to_text) == (
        "# T\na [link bold](u?x=1) b\nanchor\n- one\n- two\nopen never closed <!-- nor this")


def postgres_contains(held, wanted, top=True):
    if isinstance(wanted, dict):
        return isinstance(held, dict) and all(k in held and postgres_contains(held[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(held, list) and all(any(postgres_contains(h, w, False) for h in held) for w in wanted)
    if top and isinstance(held, list):
        return any(postgres_contains(h, wanted, False) for h in held)
    if isinstance(held, bool) or isinstance(wanted, bool) or held is None or wanted is None:
        return held is wanted
    return not isinstance(held, (dict, list)) and isinstance(held, str) == isinstance(wanted, str) and held == wanted


def test_nested_containment(spark):
    values = [
        {"a": 1, "b": {"c": [1, "x", {"d": None}], "e": True}}, {"a": 1.0}, {"a": "1"}, {"a": None}, {}, [], [1, 2, [3]], ["x"], "x",
        1, None, {"a": [1, 1, {"k": [2, 3]}]}, {"a": {"a": {"a": 1}}}, {"b": 1.5}, {"b": 1.50}, {"b": False}, [{"a": 1, "b": 2}],
    ]
    wanted = [
        {}, [], {"a": 1}, {"a": "1"}, {"a": None}, {"b": {"c": ["x"]}}, {"b": {"c": [{"d": None}, 1]}}, {"b": {"e": True}}, [1], [[3]], "x",
        1, None, {"a": [{"k": [3]}]}, {"a": {"a": {"a": 1}}}, {"b": 1.5}, {"b": False}, [{"b": 2}], {"a": {}}, {"a": []},
    ]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    frame = frame.withColumn("v", F.parse_json("t"))
    rows = frame.select("i", *(catalog.contains_json(F.col("v"), w).alias(f"w{j}") for j, w in enumerate(wanted))).collect()
    for r in rows:
        for j, w in enumerate(wanted):
            assert r[f"w{j}"] == postgres_contains(values[r["i"]], w), (values[r["i"]], w)


def test_totals_are_counted_by_the_writing_job(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 2500), (2, " "), (3, "b"), (4, None)], "doc_id int, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    totals = documents.write_counted(docs, chunk_sliding, str(tmp_path / "chunks"), F.col("chunk_index") == 0)
    jobs = tracker.getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stored = spark.read.parquet(str(tmp_path / "chunks")).count()
    assert totals == {"documents": 4, "chunks": stored, "succeeded": 2, "errors": 2} and len(jobs) == 1
