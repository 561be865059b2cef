"""Structured Streaming jobs for ingestion, event assembly and sessions."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from docmill.functions import text as T
from docmill.operators.chat import parse_sse
from docmill.operators.chunking import chunk_sliding
from docmill.operators.sessions import IDLE_SECONDS


FILES_PER_BATCH = 1_000
LIMIT_SECONDS = 60  # a message fails when it has no end by then


def read_table_stream(spark: SparkSession, folder: str, name: str, schema, **options) -> DataFrame:
    """Stream of the parquet table ``name`` in a folder: one file, or a folder of part files. A batch
    takes a bounded number of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    for key, value in options.items():
        reader = reader.option(key, value)
    # as a pattern the path may name a file, which the reader refuses otherwise
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def append_batches(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every micro-batch to parquet. A batch owns its folder and a repeated batch writes
    the same folder again, so a retry adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_stream(documents: DataFrame) -> DataFrame:
    """Chunks with their contents flag from a stream of documents (doc_id, text): row-wise, no
    state."""
    chunks = chunk_sliding(documents.select("doc_id", "text"))
    return chunks.withColumn("is_toc", T.is_toc(F.col("content")))


def session_stream(
    events: DataFrame,
    key: str,
    ts: str = "ts",
    idle_seconds: int = IDLE_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """Sessions per key, given out once the watermark says that they are over. With the session
    option of ``get_session`` rows are merged into sessions before the shuffle, so that a busy key
    sends few rows to its task."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    closed = timed.groupBy(
        key, F.session_window("_ts", f"{idle_seconds} seconds").alias("session")
    ).agg(F.max("_ts").alias("last_event"), F.count(F.lit(1)).alias("events"))
    return closed.select(
        key, F.col("session.start").alias("session_start"), "last_event", "events"
    )


class _Message:
    """A message while its events come in; texts are joined once, when it is given out or stored."""

    NAMES = ["content", "sources", "cited_indices", "tool_calls", "error"]

    def __init__(self, held: tuple | None = None) -> None:
        content, self.sources, self.cited, calls, self.error = held or ("", None, None, "[]", None)
        self.tokens, self.calls = [content], json.loads(calls)

    def take(self, kind: str, content: str, rest: list, at: int) -> None:
        """An event; its other texts (sources, cited_indices, tool_name, tool_args, tool_result) stand in
        columns."""
        if kind == "token":
            self.tokens.append(content)
        elif kind == "sources" and rest[0][at] is not None:
            self.sources, self.cited = rest[0][at], rest[1][at]
        elif kind == "tool_call":
            self.calls.append([column[at] for column in rest[2:]])
        elif kind == "error":
            self.fail(content)

    def fail(self, reason: str = "") -> None:
        self.error = reason or "An error occurred"

    def row(self) -> tuple:
        return "".join(self.tokens), self.sources, self.cited, json.dumps(self.calls), self.error


def _events_in_order(batches: Iterator[pd.DataFrame]) -> list:
    """The events of one message by ``seq`` (none last), equal ones in any order, as plain tuples."""
    found = []
    for batch in batches:
        event = namedtuple("Event", batch.columns)
        found.extend(map(event._make, zip(*(batch[name].tolist() for name in batch.columns), strict=True)))
    return sorted(found, key=lambda e: (pd.isna(e.seq), e.seq))


BUCKETS = 1_024  # groups that keys are dealt to; fixed, as the state of a stream is found by them


def _bucketed(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with their group. Whole numbers in the key become text: in a frame a null beside them
    would turn them into fractions."""
    whole = {f.name for f in rows.schema.fields if isinstance(f.dataType, IntegralType)}
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")).withColumns(
        {k: F.col(k).cast("string") for k in key if k in whole})


def _key_types(rows: DataFrame, key: list[str]) -> tuple[list[str], list[str]]:
    """The types of the key's columns and of the same after :func:`_bucketed`."""
    fields = {f.name: f for f in rows.schema.fields}
    types = [fields[k].dataType.simpleString() for k in key]
    return types, ["string" if isinstance(fields[k].dataType, IntegralType) else t for k, t in zip(key, types)]


def _rows_by_key(batches: Iterator[pd.DataFrame], key: list[str], order: str | None) -> tuple[pd.DataFrame, list]:
    """The rows of a group's call: a frame sorted by key, inside it by ``order`` (none last) or as they
    came, then for every key its values, its first row and the one behind its last."""
    frame = pd.concat(list(batches), ignore_index=True)
    codes = frame.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
    inside = [frame[order].to_numpy()] if order else []
    frame = frame.take(np.lexsort([*inside, codes]))
    codes = np.sort(codes)
    firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    names = zip(*(_plain(frame[k].iloc[firsts]) for k in key), strict=True)
    return frame, [*zip(names, firsts.tolist(), [*firsts[1:].tolist(), len(codes)], strict=True)]


def _plain(values: pd.Series) -> list:
    return [None if pd.isna(v) else v for v in values.tolist()]


def _held(state: GroupState, width: int) -> dict[tuple, list]:
    """What the state of a group holds per key: arrays side by side, the first ``width`` are the key."""
    rows = zip(*state.get, strict=True) if state.exists else []
    return {tuple(bytes(v) if isinstance(v, bytearray) else v for v in x[:width]): list(x[width:]) for x in rows}


def _hold(state: GroupState, held: dict[tuple, tuple], columns: int, timeout: int | None) -> None:
    if held:
        rows = [(*name, *values) for name, values in held.items()]
        state.update(tuple([r[i] for r in rows] for i in range(columns)))
        if timeout is not None:
            state.setTimeoutTimestamp(timeout)
    elif state.exists:
        state.remove()


def assemble_stream(
    events: DataFrame, key: list[str], ts: str | None = None, limit_seconds: int = LIMIT_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """Messages from a stream of parsed events, given out when they are done or have failed. Until
    then the state of a message holds what has come of it, so it does not matter where the stream is
    cut into batches. The events of a message are taken in ``seq`` order inside a batch; columns as in
    ``assemble_messages``.

    With ``ts`` (event time) a message has ``limit_seconds`` from its first event: one without an end
    by then fails, when the watermark passes the limit or a later event of its key comes, which then
    opens the next message. So no state outlives its limit. Without ``ts`` messages wait for their end.

    Messages are handed to Python a group at a time, as a call costs as much as hundreds of events. The
    state of a group holds its open messages, each with its own limit.
    """
    types, coded = _key_types(events, key)
    names = _Message.NAMES
    if ts:
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
        events = events.withColumn("_ms", F.unix_millis(ts))
    timed = ts is not None
    limit = limit_seconds * 1000
    width = len(key)

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held = [], _held(state, width)
        now = state.getCurrentWatermarkMs() if timed else None
        touched = {}
        if not state.hasTimedOut:
            frame, found = _rows_by_key(batches, key, "seq")
            kinds, texts = frame["type"].tolist(), frame["content"].tolist()
            moments = frame["ms"].tolist() if timed else None
            rest = [frame[n].to_numpy() for n in ("sources", "cited_indices", "tool_name", "tool_args", "tool_result")]
            for who, first, end in found:
                message = started = None
                if who in held:
                    *parts, started, _ = held.pop(who)
                    message = _Message(tuple(parts))
                for i in range(first, end):
                    if timed and message and moments[i] >= started + limit:
                        message.fail()
                        out.append([*who, *message.row(), False])
                        message = None
                    if message is None:
                        message, started = _Message(), moments[i] if timed else 0
                    kind = kinds[i]
                    message.take(kind, texts[i], rest, i)
                    if kind in ("done", "error"):
                        out.append([*who, *message.row(), kind == "done"])
                        message = None
                if message:
                    touched[who] = (*message.row(), started, max(started + limit, now + 1) if timed else 0)
        if timed:  # those whose time is over, unless they have events now
            for who in [w for w, values in held.items() if values[-1] < now]:
                message = _Message(tuple(held.pop(who)[:-2]))
                message.fail()
                out.append([*who, *message.row(), False])
        held |= touched
        _hold(state, held, width + len(names) + 2, min(v[-1] for v in held.values()) if timed and held else None)
        if out:
            yield pd.DataFrame(out, columns=[*key, *names, "done"])

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    events = _bucketed(events.withColumnRenamed("_ms", "ms"), key)
    # a column costs each call as much as dozens of events: only those that are read go in
    read = ["seq", "type", "content", "sources", "cited_indices", "tool_name", "tool_args", "tool_result", *(["ms"] if timed else [])]
    given = ", ".join([*(f"{k} {t}" for k, t in zip(key, coded)), *(f"{n} string" for n in names), "done boolean"])
    kept = ", ".join([*(f"{k} array<{t}>" for k, t in zip(key, coded)), *(f"{n} array<string>" for n in names),
                      "started array<long>", "until array<long>"])
    found = events.select("_bucket", *key, *([ts] if timed else []), *read).groupBy("_bucket").applyInPandasWithState(
        fold, given, kept, "append", timeout
    )
    calls = F.transform(
        F.from_json("tool_calls", "array<array<string>>"),
        lambda c: F.struct(c[0].alias("tool_name"), c[1].alias("tool_args"), c[2].alias("tool_result")),
    )
    return found.withColumns({k: F.col(k).cast(t) for k, t in zip(key, types)} | {"tool_calls": calls})


def frame_stream(
    pieces: DataFrame,
    key: list[str],
    number: str = "piece_no",
    piece: str = "piece",
    ts: str = "ts",
    idle_seconds: int = IDLE_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """Whole events out of a stream of byte pieces that end anywhere: in an event, a line or a
    letter. Gives ``frame`` (text that ends with a blank line) and ``first_event`` (how many events of
    the connection came before it) per connection and batch; :func:`parse_frames` reads them.

    The state of a connection holds the bytes after its last blank line. Pieces are taken by their
    number from 0 on: one that comes again is dropped, one that comes early waits for those before it.
    What has no end after ``idle_seconds`` without a piece is forgotten, so the state is bounded by the
    connections that are open. Connections are handed to Python a group at a time, see
    :func:`assemble_stream`.
    """
    types, coded = _key_types(pieces, key)
    timed = pieces.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = _bucketed(timed, key).select(
        "_bucket", *key, "_ts", F.unix_millis("_ts").alias("ms"), F.col(number).cast("long").alias("no"),
        F.col(piece).cast("binary").alias("bytes"),
    )
    width, idle = len(key), idle_seconds * 1000

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held, now = [], _held(state, width), state.getCurrentWatermarkMs()
        touched = {}
        if not state.hasTimedOut:
            frame, found = _rows_by_key(batches, key, None)
            numbers = frame["no"].fillna(-1).astype("int64").tolist()  # one without a number is dropped
            parts, moments = frame["bytes"].tolist(), frame["ms"].to_numpy()
            for who, first, end in found:
                next_, events, last, rest, early_no, early, _ = held.pop(who, (0, 0, 0, b"", [], [], 0))
                waiting = dict(zip(early_no, early, strict=True))
                last = max(last, int(moments[first:end].max()))
                waiting.update((n, p) for n, p in zip(numbers[first:end], parts[first:end], strict=True) if n >= next_)
                ready = []
                while next_ in waiting:
                    ready.append(bytes(waiting.pop(next_) or b""))
                    next_ += 1
                whole, count, rest = split_frames(bytes(rest), b"".join(ready))
                if count:
                    out.append([*who, events, whole.decode("utf-8", "replace")])
                events += count
                touched[who] = (next_, events, last, rest, list(waiting), list(waiting.values()), max(last + idle, now + 1))
        # what has been idle for too long goes, unless it has pieces now
        held = {who: values for who, values in held.items() if values[-1] >= now} | touched
        _hold(state, held, width + 7, min(v[-1] for v in held.values()) if held else None)
        if out:
            yield pd.DataFrame(out, columns=[*key, "first_event", "frame"])

    given = ", ".join([*(f"{k} {t}" for k, t in zip(key, coded)), "first_event long", "frame string"])
    kept = ", ".join([*(f"{k} array<{t}>" for k, t in zip(key, coded)), "next array<long>", "events array<long>", "last array<long>",
                      "rest array<binary>", "early_no array<array<long>>", "early array<array<binary>>", "until array<long>"])
    found = rows.groupBy("_bucket").applyInPandasWithState(fold, given, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({k: F.col(k).cast(t) for k, t in zip(key, types)})


def split_frames(rest: bytes, new: bytes) -> tuple[bytes, int, bytes]:
    """``rest + new`` up to its last blank line, the number of events in it, and what is left over.
    ``rest`` has no blank line."""
    whole = rest + new
    ends, at = [], whole.find(b"\n\n", max(0, len(rest) - 1))
    while at >= 0:
        ends.append(at + 2)
        at = whole.find(b"\n\n", at + 2)
    return (whole[: ends[-1]], len(ends), whole[ends[-1] :]) if ends else (b"", 0, whole)


def parse_frames(frames: DataFrame, key: list[str]) -> DataFrame:
    """The events of :func:`frame_stream`'s text, as ``parse_sse`` gives them for whole bodies."""
    rows = parse_sse(frames, [*key, "first_event"], "frame")
    return rows.withColumn("seq", F.col("first_event") + F.col("seq")).drop("first_event")


def history_stream(
    messages: DataFrame,
    key: str,
    order: str,
    ts: str = "ts",
    model: str = "model",
    idle_seconds: int = IDLE_SECONDS,
    delay: str = "10 minutes",
) -> DataFrame:
    """Every message of a stream with the history that is valid when it comes: ``history`` (array of
    role and content), the earlier messages of its session since the last reset. System messages are
    no part of it and get no row.

    A session is reset by ``idle_seconds`` without a message or by a message of another model than the
    last one named. An idle session's state goes once the watermark is past it, so the state is
    bounded by the sessions in use. Messages are taken by ``ts``, then ``order``, inside a batch.
    """
    fields = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    timed = messages.where(F.col("role") != "system")
    timed = timed.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = timed.select(
        key, "_ts", F.unix_millis("_ts").alias("ms"), F.col(order).alias("no"), "role", "content", F.col(model).alias("named")
    )
    idle = idle_seconds * 1000

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last, used, roles, texts = state.get if state.exists else (None, None, [], [])
            roles, texts = list(roles), list(texts)
            for row in pd.concat(list(batches)).sort_values(["ms", "no"]).itertuples():
                named = row.named if isinstance(row.named, str) and row.named else None
                idled = last is not None and row.ms - last >= idle
                if idled or (named and used and named != used):
                    roles, texts = [], []
                used = named or (None if idled else used)
                history = [{"role": r, "content": t} for r, t in zip(roles, texts, strict=True)]
                out.append([*name, row.no, history])
                roles.append(row.role)
                texts.append(row.content)
                last = row.ms
            state.update((last, used, roles, texts))
            state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, order, "history"])

    return rows.groupBy(key).applyInPandasWithState(
        fold,
        f"{key} {fields[key]}, {order} {fields[order]}, history array<struct<role: string, content: string>>",
        "last long, used string, roles array<string>, texts array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def first_per_period(requests: DataFrame, key: list[str], ts: str, period: str) -> DataFrame:
    """First request of each key per period of event time; repeats inside it are dropped."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, period)
    return timed.dropDuplicatesWithinWatermark(key)
