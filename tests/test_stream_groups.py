"""Streams whose keys are handed to Python a group at a time."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import chat
from docmill.plans import streaming
from docmill.streaming import jobs

from test_streams import run_waves


def none():
    return [F.lit(None).cast("string").alias(n) for n in ("sources", "cited_indices", "tool_name", "tool_args", "tool_result")]


@pytest.mark.parametrize("groups", [1, 1024])
def test_messages_of_a_group_keep_their_own_limits(spark, tmp_path, monkeypatch, groups):
    """Each message ends by its own time, also when others of its group get events; null and large keys stay apart."""
    monkeypatch.setattr(jobs, "BUCKETS", groups)
    big = 2**60 + 1
    events = [  # message, turn, seq, second, type, content
        (big, 0, 1, 1, "token", "b"), (big, 0, 0, 0, "token", "a"), (None, 0, 0, 0, "token", "n"), (big + 1, 0, 0, 50, "token", "c"),
        (7, 0, 0, 100, "token", "x"), (7, 1, 0, 100, "error", ""), (8, 0, None, 101, "token", "z"), (8, 0, 0, 101, "token", "y"),
        (7, 0, 1, 159, "token", "y"), (9, 0, 0, 150, "token", "q"), (7, 0, 2, 159, "done", ""), (big + 1, 0, 1, 155, "done", ""),
        (8, 0, 1, 170, "done", ""), (1, 0, 0, 1000, "token", ""),
    ]
    made = spark.createDataFrame(events, "conv bigint, turn int, seq int, s int, type string, content string")
    made = made.select("*", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"), *none())
    waves = [made.where("s <= 101"), made.where("s between 150 and 170"), made.where("s > 170")]
    found = run_waves(spark, tmp_path, "own", waves, lambda e: jobs.assemble_stream(e, ["conv", "turn"], "ts", delay="0 seconds"))
    failed = "An error occurred"
    assert found.schema["conv"].dataType.simpleString() == "bigint" and found.schema["turn"].dataType.simpleString() == "int"
    assert sorted((str(r["conv"]), r["turn"], r["content"], r["error"], r["done"]) for r in found.collect()) == sorted([
        (str(big), 0, "ab", failed, False), ("None", 0, "n", failed, False), (str(big + 1), 0, "c", failed, False),
        (str(big + 1), 0, "", None, True), ("7", 1, "", failed, False), ("7", 0, "xy", None, True),
        ("8", 0, "yz", failed, False), ("8", 0, "", None, True), ("9", 0, "q", failed, False)])


def test_state_has_a_row_per_group(spark, tmp_path):
    """A call and a row of the state serve many messages: both are bounded by the groups, not the messages."""
    made = spark.range(3_000).select(F.col("id").alias("m"), F.lit(0).alias("seq"), F.lit("token").alias("type"), F.lit("x").alias("content"),
                                     F.timestamp_seconds(F.lit(10_000)).alias("ts"), *none())
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.assemble_stream(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), ["m"], "ts")
    query = jobs.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert 500 < query.lastProgress.stateOperators[0].numRowsTotal <= jobs.BUCKETS


@pytest.mark.parametrize("groups", [1, 1024])
def test_connections_of_a_group(spark, tmp_path, monkeypatch, groups):
    """Connections side by side, their pieces mixed over three starts; one is forgotten when it is idle."""
    monkeypatch.setattr(jobs, "BUCKETS", groups)
    rng, rows, bodies = random.Random(6), [], []
    for c in range(12):
        body = "".join(f'event: token\ndata: {{"content": "é{c}-{i}"}}\n\n' for i in range(rng.randrange(0, 6))) + "event: to"
        bodies.append((c, body))
        size, raw = rng.randrange(3, 30), body.encode()
        cut = [bytearray(raw[i : i + size]) for i in range(0, len(raw), size)]
        rows += [(c, n, p, n % 3 if c % 2 else n * 3 // len(cut)) for n, p in enumerate(cut)]
    rng.shuffle(rows)
    # an idle one: the second part comes when its first has been forgotten
    old = 'event: token\ndata: {"content": "old"}\n\n'.encode()
    rows += [(99, 0, bytearray(old[:9]), 0), (99, 1, bytearray(old[9:]), 2), (None, 0, bytearray(b"event: done\ndata: {}\n\n"), 1), (5, None, bytearray(b"?"), 1)]
    made = spark.createDataFrame(rows, "m int, piece_no int, piece binary, wave int")
    made = made.withColumn("ts", F.timestamp_seconds(F.lit(10_000) + F.col("wave") * 900 - F.when(F.col("m") == 99, 200).otherwise(0)))
    waves = [made.where(F.col("wave") == i).drop("wave") for i in range(3)]
    found = run_waves(spark, tmp_path, "mixed", waves,
                      lambda p: jobs.parse_frames(jobs.frame_stream(p, ["m"], idle_seconds=1_000, delay="0 seconds"), ["m"]))
    whole = chat.parse_sse(spark.createDataFrame([*bodies, (None, "event: done\ndata: {}\n\n")], "m int, body string"), ["m"])
    columns = ["m", "seq", "type", "content"]
    want = sorted(map(str, whole.select(columns).collect()))
    assert sorted(map(str, found.select(columns).collect())) == want and len(want) > 20


def test_waves_are_made_once(spark, monkeypatch):
    """Rows are computed once for all starts; a wave without rows is passed over."""
    count = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    rows = spark.range(90).mapInArrow(seen, "id bigint")
    for wave in (F.col("id") % 3, F.lit(2)):
        before = count.value
        assert sorted(r[0] for r in streaming._run_in_waves(spark, rows, wave.cast("int"), lambda r: r).collect()) == list(range(90))
        assert count.value - before == 90
