"""Splitting documents into chunks, numbering and describing them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.arrays import explode_rows, let

LOOKBACK = 200  # how far back from a window's end a sentence end is searched
TOKEN_BUCKETS = [(0, 128), (128, 256), (256, 384), (384, 512)]


@dataclass(frozen=True)
class ChunkingConfig:
    """Checked limits of the ingestion settings."""

    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    max_tokens: int = 512

    def __post_init__(self):
        if not 100 <= self.chunk_size <= 5000:
            raise ValueError("chunk_size must be between 100 and 5000")
        if not 0 <= self.chunk_overlap <= 1000:
            raise ValueError("chunk_overlap must be between 0 and 1000")
        if not 500 <= self.max_tokens <= 10000:
            raise ValueError("max_tokens must be between 500 and 10000")
        check_window(self.chunk_size, self.chunk_overlap, self.min_chunk_size)


def check_window(size: int, overlap: int, min_size: int) -> None:
    if overlap >= size:
        raise ValueError(f"overlap {overlap} does not fit windows of {size}")
    if min_size <= 0:
        raise ValueError("the least window size must be above zero")
    if overlap >= max(min_size, size - LOOKBACK) + 2:
        raise ValueError("these settings could move a window backwards")


def _window_pattern(size: int, overlap: int, min_size: int) -> str:
    """One match per window that more than ``size`` characters are left for: its text behind the end
    of the window before. So matches tile the text, and a place is tested for a sentence end by one
    character.

    A window ends at a sentence end as late as possible inside the look-back zone, else at ``size``.
    """
    shortest = max(min_size, size - LOOKBACK) + 2

    def part(seen: int) -> str:
        sentence = rf".{{{shortest - 1 - seen},{size - seen}}}[.!?\n]|" if shortest <= size + 1 else ""
        return rf"(?=.{{{size + 1 - seen}}})(?:{sentence}.{{{size - seen}}})"

    return rf"(?s)\G(?:\A{part(0)}|(?!\A){part(overlap)})"


def sliding_windows(
    content: Column, size: int = 1000, overlap: int = 200, min_size: int = 100
) -> Column:
    """Array of ``(text, advance)``: a window and how far the next one starts after it."""
    check_window(size, overlap, min_size)
    pattern = F.lit(_window_pattern(size, overlap, min_size))
    step = size - overlap
    parts = F.regexp_extract_all(content, pattern, F.lit(0))
    # as many parts as hold an overlap whatever their length
    held = max(1, -(-overlap // (max(min_size, size - LOOKBACK) + 2 - overlap)))

    def before(all_parts: Column) -> Column:
        """The overlap that each part's window begins with."""

        def ends(_: Column, i: Column) -> Column:
            near = F.concat_ws("", *(F.get(all_parts, i - back) for back in range(held, 0, -1)))
            return F.right(near, F.lit(overlap))

        return F.transform(all_parts, ends)

    whole = F.zip_with(
        parts,
        let(F.regexp_extract_all(content, pattern, F.lit(0)), before),
        lambda p, b: F.struct(
            F.concat(b, p).alias("text"), (F.length(b) + F.length(p) - overlap).alias("advance")
        ),
    )

    def with_tail(full: Column) -> Column:
        """Windows over the last characters follow, ``size`` at most."""
        left = F.length(content) - F.aggregate(full, F.lit(0), lambda at, w: at + w["advance"])
        tail = F.struct(left.alias("size"), F.right(content, left).alias("text"))
        windows = let(tail, lambda t: F.transform(
            F.when(t["size"] > 0, F.sequence(F.lit(0), t["size"] - 1, F.lit(step))).otherwise(F.array().cast("array<int>")),
            lambda at: F.struct(
                F.substring(t["text"], at + 1, F.lit(size)).alias("text"),
                F.least(F.lit(step), t["size"] - at).alias("advance"),
            ),
        ))
        return F.concat(full, windows)

    return let(whole, with_tail)


def chunk_sliding(
    docs: DataFrame,
    size: int = 1000,
    overlap: int = 200,
    min_size: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Overlapping windows that prefer to end at ``.``, ``!``, ``?`` or a line break.

    Text is stripped, offsets are not; blank windows use no index; the last window's end is
    its start plus ``size``. Everything happens inside the row: no shuffle.
    """
    windows = sliding_windows(F.col(text_col), size, overlap, min_size)
    # running start = sum of the advances before; kept as an array beside the windows
    rows = docs.withColumn("_w", windows)
    rows = rows.withColumn(
        "_s",
        F.aggregate(
            "_w",
            F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")),
            lambda acc, w: F.struct(
                F.array_append(acc["starts"], acc["at"]).alias("starts"),
                (acc["at"] + w["advance"]).alias("at"),
            ),
            lambda acc: acc["starts"],
        ),
    )
    placed = let(F.length(F.col(text_col)), lambda length: F.zip_with(
        "_w",
        "_s",
        lambda w, s: F.struct(
            T.strip(w["text"]).alias("content"),
            s.alias("start_char"),
            F.when(s + size >= length, s + size)
            .otherwise(s + F.length(w["text"]))
            .alias("end_char"),
        ),
    ))
    kept = F.filter(placed, lambda c: c["content"] != "")
    keep = [c for c in docs.columns if c != text_col]
    out = rows.select(*keep, kept.alias("_c"))
    out = explode_rows(out, "_c", [*keep, F.size("_c").alias("total_chunks")], "col", "pos")
    return out.select(
        *keep,
        F.col("pos").alias("chunk_index"),
        "col.content",
        "col.start_char",
        "col.end_char",
        "total_chunks",
        T.token_estimate(F.col("col.content")).alias("token_count"),
    )


def _blocks_under_paths(text: Column, longest: int | None = None) -> Column:
    """Paragraphs of markdown text in order, each with the headings above it, one a line. Of a path
    above ``longest`` letters the end is kept."""
    block = T.strip
    blocks = F.filter(
        F.transform(
            F.split(
                F.regexp_replace(
                    text, r"(?m)^(#{1,6}[\t-\r\x20]+.*)$", "\n\n$1\n\n"
                ),
                r"\n[\t\x20]*\n\s*",
            ),
            block,
        ),
        lambda b: b != "",
    )
    level = lambda b: F.length(F.regexp_extract(b, r"^(#{1,6})[\t-\r\x20]", 1))
    empty = F.array().cast("array<struct<level:int,name:string>>")
    chunk_type = "array<struct<path:string,body:string>>"

    def heading(acc: Column, b: Column, depth: Column) -> Column:
        name = T.strip(F.regexp_replace(b, r"^#{1,6}[\t-\r\x20]+", ""))
        heads = F.array_append(
            F.filter(acc["heads"], lambda h: h["level"] < depth),
            F.struct(depth.cast("int").alias("level"), name.alias("name")),
        )
        return F.struct(heads.alias("heads"), acc["blocks"].alias("blocks"))

    def place(acc: Column, b: Column) -> Column:
        path = F.array_join(F.transform(acc["heads"], lambda h: h["name"]), "\n")
        if longest is not None:
            path = F.when(F.length(path) > longest, block(F.right(path, F.lit(longest)))).otherwise(path)
        placed = F.array_append(acc["blocks"], F.struct(path.alias("path"), b.alias("body")))
        return F.struct(acc["heads"].alias("heads"), placed.alias("blocks"))

    def step(acc: Column, b: Column) -> Column:
        return let(
            level(b),
            lambda depth: F.when(depth > 0, heading(acc, b, depth)).otherwise(place(acc, b)),
        )

    return F.aggregate(
        blocks,
        F.struct(empty.alias("heads"), F.array().cast(chunk_type).alias("blocks")),
        step,
        lambda acc: acc["blocks"],
    )


def chunk_structured(
    docs: DataFrame,
    max_tokens: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Chunks that follow the structure of markdown text.

    Blocks are paragraphs (blank-line separated) and headings. Neighbouring blocks under the
    same heading path are packed as long as path and blocks together have up to ``max_tokens``
    estimated tokens, a block longer than that is cut at white space, and every chunk starts
    with its heading path. Of a path that takes more than half a chunk only the end is kept. All
    of it is a fold over the blocks of one row, so documents never meet.
    """
    limit = max_tokens * 4
    block = T.strip
    chunk_type = "array<struct<path:string,body:string>>"

    def room(path: Column) -> Column:
        """Characters that the path leaves for the body."""
        return F.lit(limit) - F.when(path == "", 0).otherwise(F.length(path) + 1)

    placed = _blocks_under_paths(F.col(text_col), limit // 2)

    # cut over-long blocks at the last white space that fits, else at the limit
    def cut(x: Column) -> Column:
        most = (room(x["path"]) - 1).cast("string")
        shape = F.concat(
            F.lit(r"(?s)(\S.{0,"), most, F.lit(r"}(?=\s|$)|\S.{0,"), most, F.lit("})")
        )
        return F.transform(
            F.regexp_extract_all(x["body"], shape, F.lit(1)),
            lambda part: F.struct(x["path"].alias("path"), block(part).alias("body")),
        )

    pieces = F.flatten(
        F.transform(
            F.col("_placed"),
            lambda x: F.when(F.length(x["body"]) <= room(x["path"]), F.array(x)).otherwise(cut(x)),
        )
    )

    def pack(chunks: Column, x: Column) -> Column:
        last = F.try_element_at(chunks, F.lit(-1))
        joins = (
            last.isNotNull()
            & (last["path"] == x["path"])
            & (F.length(last["body"]) + 1 + F.length(x["body"]) <= room(x["path"]))
        )
        joined = F.struct(
            x["path"].alias("path"), F.concat(last["body"], F.lit("\n"), x["body"]).alias("body")
        )
        return F.when(
            joins, F.array_append(F.slice(chunks, F.lit(1), F.size(chunks) - 1), joined)
        ).otherwise(F.array_append(chunks, x))

    packed = F.aggregate(F.col("_pieces"), F.array().cast(chunk_type), pack)
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, placed.alias("_placed")).select(*keep, pieces.alias("_pieces"))
    rows = rows.select(*keep, packed.alias("_c"))
    body = F.when(F.col("col.path") == "", F.col("col.body")).otherwise(
        F.concat_ws("\n", "col.path", "col.body")
    )
    out = explode_rows(rows, "_c", [*keep, F.size("_c").alias("total_chunks")], "col", "pos")
    out = out.select(
        *keep,
        F.col("pos").alias("chunk_index"),
        F.col("col.path").alias("heading_path"),
        body.alias("content"),
        "total_chunks",
    )
    return out.withColumn("token_count", T.token_estimate(F.col("content")))


Counter = Callable[[Column], Column]


def word_counter(texts: Column) -> Column:
    """Words of each text of an array."""
    return F.transform(texts, lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))))


def tokenizer_counter(tokenizer: Callable[[str], list]) -> Counter:
    """Tokens of each text of an array by a tokenizer function."""

    @F.pandas_udf("array<int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda texts: [len(tokenizer(t)) for t in texts], na_action="ignore")

    return count


def token_cuts(blocks: list[int], counts: list[int], path_ids: list[int], path_sizes: list[int], most: int, line: int) -> list[int]:
    """Where chunks begin among the pieces of a text. ``blocks`` and ``counts`` belong to a piece,
    ``path_ids`` and ``path_sizes`` to a block; a line break takes ``line`` tokens."""
    sizes: dict[int, int] = {}
    for block, count in zip(blocks, counts, strict=True):
        sizes[block] = sizes.get(block, 0) + count
    starts, used, path, before, room = [], 0, None, None, most
    for at, (block, count) in enumerate(zip(blocks, counts, strict=True)):
        if block != before:  # a block joins the chunk if all of it fits
            if path is None or path_ids[block] != path or used + line + sizes[block] > room:
                starts.append(at)
                path, used = path_ids[block], 0
                room = most - path_sizes[block] - (line if path_sizes[block] else 0)
            else:
                used += line
            before = block
        elif used + count > room and used:  # a block longer than a chunk is cut between pieces
            starts.append(at)
            used = 0
        used += count
    return starts


def chunk_tokens(
    docs: DataFrame, counter: Counter, max_tokens: int = 512, line_tokens: int = 0, text_col: str = "text"
) -> DataFrame:
    """Chunks as ``chunk_structured`` makes them, packed by counted tokens.

    ``counter`` counts the tokens of every word with the white space before it; running totals decide
    where a chunk ends, so the work is linear in the text. Paragraphs under the same headings share a
    chunk while all of them fit; one that is longer by itself is cut between words. Headings that take
    more than half of a chunk are left out. ``line_tokens`` is what a line break takes. A single word
    above the limit is a chunk of its own.
    """
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, _blocks_under_paths(F.col(text_col)).alias("_placed"))
    words = F.flatten(F.transform("_placed", lambda x, i: F.transform(
        F.regexp_extract_all(x["body"], F.lit(r"\s*\S+"), F.lit(0)),
        lambda w, j: F.struct(i.alias("block"), (j == 0).alias("opens"), w.alias("text")),
    )))
    rows = rows.select(*keep, words.alias("_words"), F.transform("_placed", lambda x: x["path"]).alias("_paths"))
    rows = rows.withColumns({
        "_counts": counter(F.transform("_words", lambda w: w["text"])), "_sizes": counter(F.col("_paths")),
    })
    # one row's columns through Python: numbers only
    short = F.transform("_sizes", lambda n: F.when(n * 2 <= max_tokens, n).otherwise(0))
    shown = F.zip_with("_paths", "_sizes", lambda p, n: F.when(n * 2 <= max_tokens, p).otherwise(""))
    rows = rows.withColumns({"_sizes": short, "_paths": shown})
    ids = F.transform("_paths", lambda p: F.array_position("_paths", p).cast("int"))

    @F.pandas_udf("array<int>")
    def cuts(blocks: pd.Series, counts: pd.Series, path_ids: pd.Series, path_sizes: pd.Series) -> pd.Series:
        made = zip(blocks, counts, path_ids, path_sizes, strict=True)
        return pd.Series([token_cuts(*(list(x) for x in row), max_tokens, line_tokens) for row in made])

    rows = rows.withColumn("_ids", ids).withColumn(
        "_starts", cuts(F.transform("_words", lambda w: w["block"]), F.col("_counts"), F.col("_ids"), F.col("_sizes")))
    stop = lambda i: F.coalesce(F.get("_starts", i + 1), F.size("_words"))
    parts = F.transform("_starts", lambda s, i: F.struct(
        F.get("_paths", F.get("_words", s)["block"]).alias("path"),
        T.strip(F.array_join(F.transform(
            F.slice("_words", s + 1, stop(i) - s),
            lambda w: F.when(w["opens"], F.concat(F.lit("\n"), w["text"])).otherwise(w["text"])), "")).alias("body"),
        F.aggregate(F.slice("_counts", s + 1, stop(i) - s), F.lit(0), lambda n, c: n + c).alias("count"),
    ))
    rows = rows.select(*keep, parts.alias("_c"))
    out = explode_rows(rows, "_c", [*keep, F.size("_c").alias("total_chunks")], "col", "pos")
    body = F.when(F.col("col.path") == "", F.col("col.body")).otherwise(F.concat_ws("\n", "col.path", "col.body"))
    return out.select(
        *keep, F.col("pos").alias("chunk_index"), F.col("col.path").alias("heading_path"), body.alias("content"),
        "total_chunks", F.col("col.count").alias("body_tokens"),
    )


def with_page_range(items: DataFrame, chunk_cols: list[str]) -> DataFrame:
    """First and last page per chunk from one row per item.

    Needs ``meta_page`` (page named on the chunk itself, or NULL) and ``page_no`` (first
    provenance page of the item, or NULL). The chunk's own page wins.
    """
    grouped = items.groupBy(*chunk_cols).agg(
        F.max("meta_page").alias("_own"),
        F.min("page_no").alias("_first"),
        F.max("page_no").alias("_last"),
    )
    return grouped.select(
        *chunk_cols,
        F.coalesce("_own", "_first").alias("page_start"),
        F.coalesce("_own", "_last").alias("page_end"),
    )


def chunk_offsets(
    chunks: DataFrame,
    order: str,
    id_col: str = "doc_id",
    text_col: str = "content",
) -> DataFrame:
    """Index, count and running character offsets of chunks laid end to end per document.

    The window holds the chunks of one document only.
    """
    w = Window.partitionBy(id_col).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.col(text_col))
    start = F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint")
    return chunks.select(
        "*",
        (F.row_number().over(w) - 1).alias("chunk_no"),
        F.count(F.lit(1)).over(Window.partitionBy(id_col)).alias("chunks_in_doc"),
        start.alias("offset_start"),
        (start + size).alias("offset_end"),
    )


def chunk_stats(chunks: DataFrame, tokens: str = "token_count", by: list[str] = ()) -> DataFrame:
    """Count, token totals and a histogram; 512 tokens and more fall in no bucket."""
    n = F.col(tokens)
    buckets = [
        F.count_if((n >= lo) & (n < hi)).alias(f"tokens_{lo}_{hi}") for lo, hi in TOKEN_BUCKETS
    ]
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(n).alias("total_tokens"),
        F.round(F.avg(n), 9).alias("avg_tokens"),
        F.min(n).alias("min_tokens"),
        F.max(n).alias("max_tokens"),
        *buckets,
    )


def with_token_count(
    chunks: DataFrame,
    tokenizer: Callable[[str], list] | None = None,
    text_col: str = "content",
) -> DataFrame:
    """Token count by a tokenizer function, or a quarter of the characters without one."""
    if tokenizer is None:
        return chunks.withColumn("token_count", T.token_estimate(F.col(text_col)))

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: len(tokenizer(t)), na_action="ignore").astype("Int32")

    return chunks.withColumn("token_count", count(text_col))


def export_text(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """Chunk as a printable block between separator lines."""
    bar = F.lit("=" * 60)
    return chunks.withColumn(
        "value",
        F.concat(
            bar, F.lit("\nCHUNK "), F.col("chunk_index").cast("string"), F.lit("\n"), bar,
            F.lit("\n"), F.col(text_col), F.lit("\n"),
        ),
    )
