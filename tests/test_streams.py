"""Stateful streams: pieces of event text, time limits, history."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.arrays import explode_rows
from docmill.functions.stemming import french_stems
from docmill.operators import chat
from docmill.sources import store
from docmill.streaming import jobs


def run_waves(spark, tmp_path, name, waves, job):
    """Each wave (a list of DataFrames, one file each) is followed by a new start of the stream."""
    base = str(tmp_path / name)
    for wave in waves:
        wave.coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = job(spark.readStream.schema(wave.schema).parquet(f"{base}/in"))
        jobs.append_batches(out, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@pytest.mark.parametrize("seed", range(200))
def test_frames_wherever_the_text_is_cut(seed):
    dice = random.Random(seed)
    whole = "".join(dice.choices(["a", "é", "\n", "\n\n", "\r", "日"], k=dice.randint(0, 40))).encode()
    rest, got, count = b"", b"", 0
    at = 0
    while at < len(whole):
        size = dice.randint(1, 5)
        frame, events, rest = jobs.split_frames(rest, whole[at : at + size])
        got, count, at = got + frame, count + events, at + size
    parts = whole.split(b"\n\n")
    assert rest == parts[-1] and count == len(parts) - 1 and got + rest == whole


def test_pieces_out_of_order_and_repeated(spark, tmp_path):
    body = 'event: token\ndata: {"content": "é日"}\n\nevent: done\ndata: {}\n\nevent: token\ndata: {"content": "cut'.encode()
    pieces = [(1, i, bytearray(body[3 * i : 3 * i + 3])) for i in range(-(-len(body) // 3))]
    random.Random(3).shuffle(pieces)
    third = len(pieces) // 3
    waves = [pieces[:third], pieces[third : 2 * third] + pieces[:4], pieces[2 * third :]]
    frames = [
        spark.createDataFrame(w, "m int, piece_no int, piece binary").withColumn("ts", F.timestamp_seconds(F.lit(1000 + i)))
        for i, w in enumerate(waves)
    ]
    found = run_waves(spark, tmp_path, "frames", frames, lambda p: jobs.parse_frames(jobs.frame_stream(p, ["m"]), ["m"]))
    whole = chat.parse_sse(spark.createDataFrame([(1, body.decode())], "m int, body string"), ["m"])
    columns = ["m", "seq", "type", "content"]
    assert sorted(found.select(columns).collect()) == sorted(whole.select(columns).collect())


def test_messages_have_a_time_limit(spark, tmp_path):
    events = [  # message, seq, second, type, content
        ("a", 0, 0, "token", "x"), ("a", 1, 59, "token", "y"), ("a", 2, 59, "done", ""),
        ("b", 0, 0, "token", "x"), ("b", 1, 60, "token", "late"), ("b", 2, 61, "done", ""),
        ("c", 0, 5, "token", "x"), ("d", 0, 30, "error", "broken"),
    ]
    schema = "m string, seq int, s int, type string, content string"
    none = [F.lit(None).cast("string").alias(n) for n in ("sources", "cited_indices", "tool_name", "tool_args", "tool_result")]
    made = spark.createDataFrame(events, schema).select("*", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"), *none)
    end = spark.createDataFrame([("z", 0, 1000, "token", "")], schema).select("*", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"), *none)
    waves = [made.where("s < 40"), made.where("s >= 40"), end]
    found = run_waves(spark, tmp_path, "limit", waves, lambda e: jobs.assemble_stream(e, ["m"], "ts", delay="30 seconds"))
    failed = "An error occurred"
    assert sorted((r["m"], r["content"], r["error"], r["done"]) for r in found.collect()) == [
        ("a", "xy", None, True), ("b", "late", None, True), ("b", "x", failed, False), ("c", "x", failed, False),
        ("d", "", "broken", False)]


def test_state_ends_with_the_limit(spark, tmp_path):
    """What the state holds after many messages without an end are those inside the limit."""
    schema = "m int, seq int, type string, content string, s int"
    none = [F.lit(None).cast("string").alias(n) for n in ("sources", "cited_indices", "tool_name", "tool_args", "tool_result")]
    base, rows = str(tmp_path / "state"), []
    for wave in range(4):
        made = [(wave * 50 + i, 0, "token", "x", wave * 1000 + i) for i in range(50)]
        frame = spark.createDataFrame(made, schema).select("*", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"), *none)
        frame.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = jobs.assemble_stream(spark.readStream.schema(frame.schema).parquet(f"{base}/in"), ["m"], "ts", delay="1 second")
        query = jobs.append_batches(stream, f"{base}/out", f"{base}/cp")
        query.awaitTermination()
        rows.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert max(rows) <= 50


def test_history_is_reset(spark, tmp_path):
    rows = [  # session, turn, second, role, content, model
        ("a", 0, 0, "system", "s", None), ("a", 1, 10, "user", "1", "m"), ("a", 2, 20, "assistant", "2", None),
        ("a", 3, 30, "user", "3", "m"), ("a", 4, 40, "user", "4", "n"), ("a", 5, 50, "user", "5", None),
        ("a", 6, 3650, "user", "6", "m"), ("a", 7, 3660, "user", "7", None), ("b", 0, 15, "user", "x", None),
    ]
    frame = spark.createDataFrame(rows, "k string, turn int, s int, role string, content string, model string")
    frame = frame.withColumn("ts", F.timestamp_seconds("s"))
    waves = [frame.where("s < 25"), frame.where("s between 25 and 3655"), frame.where("s > 3655")]
    found = run_waves(spark, tmp_path, "history", waves, lambda m: jobs.history_stream(m, "k", "turn"))
    got = {(r["k"], r["turn"]): "".join(m["content"] for m in r["history"]) for r in found.collect()}
    assert got == {("a", 1): "", ("a", 2): "1", ("a", 3): "12", ("a", 4): "", ("a", 5): "4", ("a", 6): "", ("a", 7): "6", ("b", 0): ""}


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    stamp = F.timestamp_seconds(F.lit(0))
    docs = spark.range(200).select(
        F.col("id").alias("document_id"), F.lit("t").alias("title"), stamp.alias("created_at"), stamp.alias("updated_at"))
    chunks = docs.select("document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    store.write_bucketed(docs, chunks, path, 8)
    bucket = store.bucket_of(F.col("document_id"), 8)
    before = {r["bucket"]: r["version"] for r in store.bucket_versions(spark, path, "documents").collect()}
    assert len(before) == 8
    doomed = docs.where((bucket == 3) | (F.col("document_id") == 0)).select("document_id")
    first = docs.where("document_id = 0").select(bucket).first()[0]
    store.delete_bucketed(spark, path, doomed.unionAll(spark.range(1000, 1001).toDF("document_id")))
    after = {r["bucket"]: r["version"] for r in store.bucket_versions(spark, path, "documents").collect()}
    assert {b for b in before if after.get(b) != before[b]} == {3, first} and (3 in after) == (3 == first and False)
    left = store.read_bucketed(spark, path, "chunks")
    assert left.count() == 2 * (200 - doomed.distinct().count()) and left.join(doomed, "document_id", "left_semi").isEmpty()
    incoming = spark.createDataFrame([(5, "new"), (5000, "fresh")], "document_id long, title string")
    store.upsert_bucketed(spark, path, incoming, F.timestamp_seconds(F.lit(9)))
    got = {r["document_id"]: r for r in store.read_bucketed(spark, path, "documents").collect()}
    assert got[5]["title"] == "new" and got[5]["updated_at"] != got[5]["created_at"]
    assert got[5000]["created_at"] == got[5000]["updated_at"] and got[7 if 7 in got else 8]["title"] == "t"
    store.delete_bucketed(spark, path, incoming.where("1 = 0"))


# Words with their French stems, as published with the rules.
STEMS = """
continuation continu continuellement continuel continuerait continu continuité continu continuons continuon
contradictoirement contradictoir contraindre contraindr contraria contrari maintenait mainten maintenue maintenu
mairie mair maîtresses maîtress majestueusement majestu majestueux majestu majordomes majordom majorité major
malacca malacc maladive malad contorsions contors contracté contract contournant contourn majeure majeur
"""


def test_published_stems(spark):
    words = STEMS.split()
    pairs = dict(zip(words[::2], words[1::2])) | {"des": "", "étions": ""}
    frame = spark.createDataFrame([(w,) for w in pairs], "word string")
    assert {r["word"]: r["stem"] for r in french_stems(frame).collect()} == pairs
