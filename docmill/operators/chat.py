"""Chat streams, citations, sources, tool calls and message history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.arrays import explode_rows
from docmill.operators.ranking import number_rows, number_runs

MAX_DOCUMENTS = 5

# Agents by the names they answer to.
AGENTS = {
    "rag": "rag", "assistant": "rag", "default": "rag", "kb": "rag",
    "weather": "weather", "meteo": "weather", "météo": "weather",
}


def parse_mention(
    messages: DataFrame, text_col: str = "message", agents: dict[str, str] | None = None
) -> DataFrame:
    """Add ``agent_id`` and ``clean_message``; an unknown or missing ``@name`` changes nothing."""
    name, rest = T.mention(F.col(text_col))
    known = agents or AGENTS
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    agent = F.create_map(*pairs)[name]
    return messages.withColumn("agent_id", agent).withColumn(
        "clean_message", F.when(F.col("agent_id").isNotNull(), rest).otherwise(F.col(text_col))
    )


def validate_messages(messages: DataFrame) -> DataFrame:
    """Add ``valid`` and ``reason`` to requests (message, session_id, model) and strip the
    message."""
    reason = T.message_error(F.col("message"), F.col("session_id"), F.col("model"))
    return messages.withColumn("reason", reason).withColumns(
        {"valid": F.col("reason").isNull(), "message": T.strip(F.col("message"))}
    )


def cited_indices(col: Column) -> Column:
    """Distinct numbers cited as ``[n]``: not after a word character, not before ``(``."""
    # Fixed value: the citation pattern.
    hits = F.regexp_extract_all(col, F.lit(r"(?U)(?<!\w)\[([0-9]+)\](?!\()"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda n: n.try_cast("bigint"))))


def sources_event(sources: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """One event per answer: its sources by falling similarity and the cited numbers. Answers
    without sources give no event. An answer has at most one search result list of sources."""
    best_first = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("similarity")).alias("down"), "position", "title", "path", "similarity"
            )
        )
    )
    events = sources.groupBy(*key).agg(best_first.alias("sources"))
    events = events.withColumn(
        "sources",
        F.transform(
            "sources", lambda s: F.struct(s["title"], s["path"], s["similarity"])
        ),
    )
    return events.join(
        answers.select(*key, cited_indices(F.col("answer")).alias("cited_indices")), key
    )


def valid_sources(sources: DataFrame) -> DataFrame:
    """Sources that are no bare link to an outside PDF."""
    bare = (
        F.coalesce(F.lower("url").endswith(".pdf"), F.lit(False))
        & (F.coalesce("content", F.lit("")) == "")
        & (F.coalesce("metadata_content", F.lit("")) == "")
    )
    return sources.where(~bare)


def group_sources(sources: DataFrame, key: list[str]) -> DataFrame:
    """Sources of an answer grouped by document: best similarity, title and address of the
    first one, chunks by falling similarity, and the group's place (``group_no``)."""
    chunk = F.struct((-F.col("similarity")).alias("down"), "position", "similarity")
    groups = sources.groupBy(*key, "path").agg(
        F.min("position").alias("first_position"),
        F.min_by("title", "position").alias("title"),
        F.min_by("url", "position").alias("url"),
        F.max("similarity").alias("max_similarity"),
        F.array_sort(F.collect_list(chunk)).alias("chunks"),
        *([F.max("cited").alias("cited")] if "cited" in sources.columns else []),
    )
    w = Window.partitionBy(*key).orderBy(F.col("max_similarity").desc(), "first_position")
    return groups.withColumn("group_no", F.row_number().over(w))


def filter_group_sources(
    sources: DataFrame,
    cited: DataFrame,
    key: list[str],
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """Grouped sources as shown: all cited documents, then others up to ``max_documents``.

    Numbers in ``cited`` (key, cited_indices) count positions after bare PDF links are gone.
    The windows hold the sources of one answer.
    """
    numbered = valid_sources(sources).withColumn(
        "_no", F.row_number().over(Window.partitionBy(*key).orderBy("position"))
    )
    marked = numbered.join(cited.select(*key, "cited_indices"), key, "left").withColumn(
        "cited",
        F.coalesce(
            F.array_contains("cited_indices", F.col("_no").cast("bigint")), F.lit(False)
        ),
    )
    groups = group_sources(marked.drop("_no", "cited_indices"), key)
    shown = Window.partitionBy(*key).orderBy(F.col("cited").desc(), "group_no")
    placed = groups.withColumn("shown_no", F.row_number().over(shown))
    return placed.where(F.col("cited") | (F.col("shown_no") <= max_documents)).drop("group_no")


def dedup_sources(sources: DataFrame, key: list[str]) -> DataFrame:
    """The most similar source of every path, the first among equals. Cut by aggregation, so
    copies are merged before they are shuffled."""
    others = [c for c in sources.columns if c not in (*key, "path")]
    best = sources.groupBy(*key, "path").agg(
        F.min_by(
            F.struct(*others), F.struct(-F.col("similarity"), F.col("position"))
        ).alias("_best")
    )
    return best.select(*key, "path", "_best.*")


def pair_tool_calls(calls: DataFrame, results: DataFrame, order: list[str]) -> DataFrame:
    """Every call with the last result of its id, or NULL."""
    last = results.groupBy("call_id").agg(
        F.max_by("result", F.struct(*order)).alias("tool_result")
    )
    return calls.join(last, "call_id", "left")


def tool_call_runs(
    calls: DataFrame, key: str, bucket: Column, order: list[str], tool: str = "tool_name"
) -> DataFrame:
    """Consecutive calls of one tool as one row with their count. ``bucket`` splits a long
    session (see ``number_runs``)."""
    numbered = number_runs(calls, key, bucket, order, tool, "group_no")
    return numbered.groupBy(key, "group_no").agg(
        F.first(tool).alias(tool),
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct(*order)).alias("first_call"),
    )


def describe_tool_calls(calls: DataFrame, args_col: str = "args") -> DataFrame:
    """Add the key arguments of each call as shown to people: the query cut at 50 characters,
    and the limit. ``args`` is JSON text."""
    query = F.get_json_object(args_col, "$.query")
    limit = F.get_json_object(args_col, "$.limit")
    shown = F.when(F.length(query) > 50, F.concat(F.substring(query, 1, 50), F.lit("..."))).otherwise(query)
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("query='"), shown, F.lit("'")), F.concat(F.lit("limit="), limit)
        )
    )
    return calls.withColumn(
        "shown",
        F.when(F.size(parts) > 0, F.concat(
            F.col("tool_name"), F.lit(" ("), F.array_join(parts, ", "), F.lit(")")
        )).otherwise(F.col("tool_name")),
    )


def list_tool_calls(calls: DataFrame, key: str, bucket: Column, order: list[str]) -> DataFrame:
    """Every call of a session with its number from 1 and its arguments as shown. ``bucket`` must
    not decrease along ``order``; it bounds what is sorted in one task."""
    return number_rows(
        describe_tool_calls(calls), key, bucket, [F.col(c) for c in order], "call_no"
    )


def tool_usage(calls: DataFrame, order: list[str]) -> DataFrame:
    """Calls per session and tool with the first one as shown."""
    return describe_tool_calls(calls).groupBy("session_id", "tool_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.min_by("shown", F.struct(*order)).alias("first_call"),
    )


def parse_sse(bodies: DataFrame, keep: list[str], body_col: str = "body") -> DataFrame:
    """Events of server-sent-event text: ``seq, type, content, sources, cited_indices,
    tool_name, tool_args, tool_result``. Text after the last blank line is not complete and
    is held back; events without type or data, or with broken JSON, are dropped."""
    def field(event: Column, name: str) -> Column:
        """The last line with that name; empty if there is none."""
        line = F.substring_index(F.concat(F.lit("\n"), event), f"\n{name}", -1)
        return T.strip(F.substring_index(line, "\n", 1))

    # taken apart inside the array: a filter above the explode would repeat every step it looks at
    parsed = F.transform(
        F.split(body_col, "\n\n"),
        lambda e: F.struct(field(e, "event:").alias("type"), F.try_parse_json(field(e, "data:")).alias("json")),
    )
    rows = explode_rows(bodies.select(*keep, parsed.alias("_p")), F.slice(
        "_p", F.lit(1), F.size("_p") - 1), keep, "_event", "seq")
    rows = rows.select(*keep, "seq", F.col("_event.type").alias("type"), F.col("_event.json").alias("_json"))
    rows = rows.where((F.col("type") != "") & F.col("_json").isNotNull() & ~F.is_variant_null("_json"))

    def get(path: str) -> Column:
        return F.try_variant_get("_json", path, "string")

    return rows.select(
        *keep,
        "seq",
        "type",
        F.coalesce(get("$.content"), F.lit("")).alias("content"),
        get("$.sources").alias("sources"),
        get("$.cited_indices").alias("cited_indices"),
        get("$.tool_name").alias("tool_name"),
        get("$.tool_args").alias("tool_args"),
        get("$.tool_result").alias("tool_result"),
    )


def assemble_messages(events: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """One message per key: tokens joined in order, the last sources with their cited numbers,
    tool calls in order and the last error."""
    kind = F.col("type")
    token = F.when(kind == "token", F.struct(seq, "content"))
    tool = F.when(kind == "tool_call", F.struct(seq, "tool_name", "tool_args", "tool_result"))
    has_sources = (kind == "sources") & F.col("sources").isNotNull()
    parts = events.groupBy(*key).agg(
        F.array_sort(F.collect_list(token)).alias("_tokens"),
        F.array_sort(F.collect_list(tool)).alias("_tools"),
        F.max_by("sources", F.when(has_sources, F.col(seq))).alias("sources"),
        F.max_by("cited_indices", F.when(has_sources, F.col(seq))).alias("cited_indices"),
        F.max_by("content", F.when(kind == "error", F.col(seq))).alias("_error"),
        F.count_if(kind == "error").alias("_errors"),
        (F.count_if(kind == "done") > 0).alias("done"),
    )
    return parts.select(
        *key,
        F.array_join(F.transform("_tokens", lambda t: t["content"]), "").alias("content"),
        "sources",
        "cited_indices",
        F.transform(
            "_tools", lambda t: F.struct(t["tool_name"], t["tool_args"], t["tool_result"])
        ).alias("tool_calls"),
        F.when(F.col("_errors") > 0, F.when(F.col("_error") != "", F.col("_error"))
               .otherwise("An error occurred")).alias("error"),
        "done",
    )


def history_filter(
    messages: DataFrame, key: str, bucket: Column, order: list[Column], prior: str | None = None
) -> DataFrame:
    """Messages without system parts, numbered per session; with ``prior`` (a column with the
    length of the earlier history) only those after it."""
    kept = messages.where(F.col("role") != "system")
    rows = number_rows(kept, key, bucket, order, "message_no")
    return rows.where(F.col("message_no") > F.col(prior)) if prior else rows


def model_segment(messages: DataFrame, key: str, order: str, model: str = "model") -> DataFrame:
    """Messages since the last change of model. A message without a model changes nothing.

    Found with grouped maxima only, so a long session is never sorted in one task.
    """
    named = messages.where(F.col(model).isNotNull())
    per_model = named.groupBy(key, model).agg(F.max(order).alias("_last"))
    current = per_model.groupBy(key).agg(F.max_by(model, "_last").alias("_model"))
    switch = (
        per_model.join(current, key)
        .groupBy(key)
        .agg(
            F.first("_model").alias("_model"),
            F.max(F.when(F.col(model) != F.col("_model"), F.col("_last"))).alias("_switch"),
        )
    )
    begin = (
        named.join(switch, key)
        .where(
            (F.col(model) == F.col("_model"))
            & (F.col("_switch").isNull() | (F.col(order) > F.col("_switch")))
        )
        .groupBy(key)
        .agg(F.min(order).alias("_begin"), F.first("_switch").alias("_switch"))
    )
    rows = messages.join(begin, key, "left")
    keep = F.col("_switch").isNull() | (F.col(order) >= F.col("_begin"))
    return rows.where(keep).drop("_begin", "_switch")
