"""Heavy work per row is dealt to tasks whose size does not grow with the input."""

import pytest
from pyspark.sql import functions as F

from docmill import plans, tables
from docmill.functions import text as T
from docmill.operators import chat


def task_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.fixture
def one_row_group(spark, tmp_path):
    """A file cut into more splits than cores, of which one holds all rows."""
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")) \
        .coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark.read.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_without_rows_are_no_tasks(one_row_group):
    assert one_row_group.rdd.getNumPartitions() > 8 and len(task_sizes(one_row_group)) < 8
    sizes = task_sizes(tables.spread(one_row_group, "doc_id"))
    assert sum(sizes) == 20_000 and max(sizes) < 2 * tables.ROWS_PER_TASK


def test_tasks_grow_in_number_not_in_size(spark):
    for rows in (50_000, 200_000):
        sizes = task_sizes(tables.spread(spark.range(rows), "id"))
        assert sum(sizes) == rows and max(sizes) <= 4 * tables.ROWS_PER_TASK


def test_even_splits_are_left_alone(spark):
    rows = spark.range(0, 40_000, 1, 40)
    assert tables.tasks_needed(rows) is None and tables.spread(rows, "id") is rows
    assert tables.tasks_needed(spark.range(0)) == spark.sparkContext.defaultParallelism


def test_steps_of_html_to_text_are_done_once(spark):
    page = spark.createDataFrame([("<p>a</p>",)], "html string").select(T.html_to_text(F.col("html")).alias("t"))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<li") == 1 and plan.count("</a>") == 2


@pytest.mark.parametrize("name, table, columns", [
    ("sse_parse", "conversations", "cast(null as long) conv_id, 0L turn, 'user' role, concat('a ', id) text"),
    ("embed_chunks", "documents", "7L doc_id, 'en' lang, 's' source, concat('a ', id) text, 9L n_chars"),
])
def test_rows_of_one_key_are_no_single_task(spark, tmp_path, name, table, columns):
    spark.sql(f"select {columns} from range(20000)").coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    rows = plans.all_queries()[name](spark, str(tmp_path))
    sizes = task_sizes(rows)
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4


def test_events_are_taken_apart_once(spark):
    bodies = spark.createDataFrame([(1, "event: a\ndata: {}\n\n")], "m long, body string")
    plan = chat.parse_sse(bodies, ["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("event:") == 1


def test_fields_of_an_event(spark):
    events = [
        "event: a\nevent:  b \ndata: {\"content\": \"x\"}\nid: 1", "data: {}\nevent: c", "xevent: d\ndata: {}",
        "event: e\n data: {}", "event: f\ndata: 1\ndata:", "event: g\ndata: null", "event:\ndata: {}", "",
        "event: h\r\ndata: {\"content\": \"data: event:\"}\r",
    ]
    bodies = spark.createDataFrame([(1, "\n\n".join([*events, "rest"]))], "m long, body string")
    found = [(r["seq"], r["type"], r["content"]) for r in chat.parse_sse(bodies, ["m"]).orderBy("seq").collect()]
    assert found == [(0, "b", "x"), (1, "c", ""), (8, "h", "data: event:")]
