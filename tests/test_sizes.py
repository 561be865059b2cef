"""Steps whose cost per row is bounded: what made them grow is not in their plans any more."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmill import plans
from docmill.functions.markup import PAGES, html_to_markdown, markdown_of
from docmill.operators import chunking, fulltext
from docmill.streaming import jobs


def test_a_window_end_is_tested_by_one_character():
    """A look ahead over the overlap at every place made a window cost 200 x 200 steps."""
    pattern = chunking._window_pattern(1000, 200, 100)
    assert "[.!?\\n]" in pattern and not re.search(r"\(\?=[^()]*\[\.!", pattern)


@pytest.mark.parametrize("size, overlap, least", [(1000, 200, 100), (300, 200, 250), (150, 100, 120), (250, 60, 400), (100, 0, 100)])
def test_windows_are_those_of_a_walk(spark, size, overlap, least):
    text = "".join("x" * (i * 37 % 211) + ".!\n 😀é"[i % 6] for i in range(120))

    def walk(text):
        at = 0
        while at < len(text):
            end = at + size
            if end < len(text):
                ends = [i for i in range(max(at + least, end - 200) + 1, end + 1) if text[i] in ".!?\n"]
                end = ends[-1] + 1 if ends else end
                yield at, text[at:end]
                at = end - overlap
            else:
                yield at, text[at:]
                at += size - overlap

    docs = spark.createDataFrame([(n, text[:n]) for n in (0, 1, 250, 999, 1000, 1001, 1200, 1201, 5000, len(text))], "doc_id long, text string")
    got = chunking.chunk_sliding(docs, size, overlap, least).select("doc_id", "start_char", "content")
    want = [(n, at, part.strip()) for n, t in docs.collect() for at, part in walk(t) if part.strip()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_weather_payload_reads_its_number_once_a_row(spark, root):
    """It was read out of the JSON text again for each of thirty hours."""
    plan = plans.all_queries()["weather_readings"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    hours = plan[plan.index("hourly, struct(temperature_2m, "):]
    assert "get_json_object" in plan and not re.search(r"\* 7\) \+ cast\(get_json_object", hours)


def test_postings_shuffle_no_words(spark):
    """Every word went through the shuffle with the id of its chunk; now the chunks do."""
    tokens = spark.createDataFrame([(1, ["a", "b", "", "a"]), (1, ["a"]), (None, ["c"]), (2, None)], "chunk_id long, tokens array<string>")
    postings = fulltext.build_postings(tokens)
    rows = sorted(map(str, ((r["term"], r["chunk_id"], r["positions"], r["tf"]) for r in postings.collect())))
    assert rows == ["('a', 1, [0, 0, 3], 3)", "('b', 1, [1], 1)", "('c', None, [0], 1)"]
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(term" not in plan


def test_pages_are_read_a_few_at_a_time(spark):
    """A batch of pages was held as Python texts beside its columns, and their markdown too."""
    pages = [None if i % 7 == 3 else "" if i % 7 == 5 else f"<h1>t{i}</h1><p>x</p>" for i in range(2 * PAGES + 5)]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string").coalesce(1).select("id", html_to_markdown("html").alias("m"))
    assert [r["m"] for r in rows.orderBy("id").collect()] == [p if p is None else markdown_of(p) for p in pages]
    assert "ArrowEvalPython" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "], 250" in plan


def test_events_of_a_message_in_order():
    """Sorting a frame cost a short message more than all of its events."""
    batches = iter([pd.DataFrame({"seq": [4, 2], "type": ["d", "b"]}), pd.DataFrame({"seq": [3, 1], "type": ["c", "a"]})])
    assert [(e.seq, e.type) for e in jobs._events_in_order(batches)] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
