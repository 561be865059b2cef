"""Web-style keyword search over token arrays, ranked by cover density."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from docmill.functions import text as T
from docmill.functions.arrays import explode_rows, let
from docmill.operators import cover_scan as C
from docmill.operators.ranking import top_per_key
from docmill.session import cut_lineage

Analyzer = Callable[[Column], Column]
LEAD_ROWS = 4_000  # query alternatives of a set (a query has 10,000 letters at most)
LEAD_BLOCKS = 16  # most such sets sent to every executor
FORM_ROWS = 200_000  # most words of queries, in all their forms, sent to every executor
_PLACE = 2**31
ITEM = "struct<negated:boolean,words:array<string>>"


def simple_analyzer(col: Column) -> Column:
    return T.tokens(col)


def token_table(
    chunks: DataFrame, analyzer: Analyzer = simple_analyzer, carry: list[str] = ()
) -> DataFrame:
    """``(chunk_id, *carry, tokens)``; a token's place in the array is its position. An
    analyzer leaves an empty string where it removes a word, so distances stay right."""
    return chunks.select("chunk_id", *carry, analyzer(F.col("content")).alias("tokens"))


def build_postings(tokens: DataFrame) -> DataFrame:
    """``(term, chunk_id, positions, tf)``: one row per word of a chunk. The chunks are dealt by id, so
    that their words are grouped where they are and not shuffled with an id each."""
    placed = explode_rows(tokens.select("chunk_id", "tokens").repartition("chunk_id"), "tokens", ["chunk_id"], "term", "position")
    return (
        placed.where(F.col("term") != "")
        .groupBy("term", "chunk_id")
        .agg(F.array_sort(F.collect_list("position")).alias("positions"))
        .withColumn("tf", F.size("positions"))
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """How many chunks hold each word."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


PIECES = r'(-?"[^"]*"|[^\s"]+)'


def parse_queries(queries: DataFrame, analyzer: Analyzer = simple_analyzer) -> DataFrame:
    """Add ``alternatives``: words side by side must all occur, ``or`` separates alternatives,
    a leading ``-`` excludes, quotes make a phrase. A word the analyzer splits is a phrase."""
    pieces = F.regexp_extract_all(F.col("query"), F.lit(PIECES), F.lit(1))

    def described(piece: Column) -> Column:
        return F.struct(
            (F.lower(piece) == "or").alias("split"),
            piece.startswith("-").alias("negated"),
            analyzer(piece).alias("words"),
        )

    if getattr(analyzer, "outside_lambda", False):
        # one row per piece, analysed there and gathered again
        rows = explode_rows(queries, pieces, ["query_id"], "_piece", "_no")
        gathered = rows.select("query_id", "_no", described(F.col("_piece")).alias("_d"))
        gathered = gathered.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("_no", "_d"))).alias("_all")
        )
        ready = queries.join(gathered, "query_id").withColumn(
            "_words", F.transform("_all", lambda x: x["_d"])
        )
    else:
        ready = queries.withColumn("_words", F.transform(pieces, described))
    return ready.select(*queries.columns, _alternatives(F.col("_words")).alias("alternatives"))


def _alternatives(words: Column) -> Column:
    """Alternatives from described pieces: (split, negated, words) each."""
    no_items = F.array().cast(f"array<{ITEM}>")

    def step(acc: Column, p: Column) -> Column:
        item = F.struct(p["negated"].alias("negated"), _trim_gaps(p["words"]).alias("words"))
        last = F.element_at(acc, -1)
        front = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return (
            F.when(p["split"], F.array_append(acc, no_items))
            .when(F.size(item["words"]) == 0, acc)
            .otherwise(F.array_append(front, F.array_append(last, item)))
        )

    return F.filter(F.aggregate(words, F.array(no_items), step), lambda items: F.size(items) > 0)


def _trim_gaps(words: Column) -> Column:
    """Drop removed words at both ends of a phrase."""
    first = F.array_position(F.transform(words, lambda w: w != ""), F.lit(True)).cast("int")
    last = F.array_position(
        F.reverse(F.transform(words, lambda w: w != "")), F.lit(True)
    ).cast("int")
    return F.when(
        first > 0, F.slice(words, first, F.size(words) - first - last + 2)
    ).otherwise(F.array().cast("array<string>"))


def _holds(tokens: Column, words: Column) -> Column:
    """True when the words stand side by side somewhere; an empty word stands for any."""
    size = F.size(words)
    starts = F.sequence(F.lit(0), F.size(tokens) - size)
    at_place = F.exists(
        starts,
        lambda s: F.forall(
            F.sequence(F.lit(0), size - 1),
            lambda j: (F.get(words, j) == "") | (F.get(tokens, s + j) == F.get(words, j)),
        ),
    )
    return (
        F.when(size == 1, F.array_contains(tokens, F.get(words, F.lit(0))))
        .when((size > F.size(tokens)) | ~F.array_contains(tokens, F.get(words, F.lit(0))), False)
        .otherwise(at_place)
    )


def _satisfied(tokens: Column, items: Column) -> Column:
    return F.forall(items, lambda it: it["negated"] != _holds(tokens, it["words"]))


def _single(items: Column) -> Column:
    """True for an alternative that is one word to be found."""
    return (F.size(items) == 1) & ~items[0]["negated"] & (F.size(items[0]["words"]) == 1)


def positive_words(items: Column) -> Column:
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(items, lambda it: ~it["negated"]),
                lambda it: F.filter(it["words"], lambda w: w != ""),
            )
        )
    )


def cover_density(tokens: Column, terms: Column, slots: Column) -> Column:
    """Sum over the shortest stretches that hold all words of an alternative; a stretch adds
    ``0.1 / (1 + words in it that the query does not name)``. ``terms`` are distinct words, ``slots``
    has the indexes of an alternative's words among them, per alternative."""
    hits = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.struct(F.array_position(terms, t).alias("term"), i.alias("at")),
        ),
        lambda e: e["term"] > 0,
    )
    # a hit as one number: its place among the hits and its position in the text
    hits = F.transform(
        hits,
        lambda e, i: F.struct(
            e["term"].alias("term"),
            (i * F.lit(_PLACE) + e["at"]).alias("hit"),
            F.exists(slots, lambda g: (F.size(g) == 1) & (F.get(g, F.lit(0)) + 1 == e["term"])).alias("alone"),
        ),
    )
    state = F.struct(
        # per word the last hit seen, -1 before the first one; of no use to single words
        F.transform(
            F.when(F.exists(slots, lambda g: F.size(g) > 1), terms).otherwise(F.array().cast("array<string>")),
            lambda _: F.lit(-1).cast("bigint"),
        ).alias("last"),
        F.lit(-1).cast("bigint").alias("begin"),
        F.lit(0.0).alias("score"),
    )

    def latest_start(acc: Column, e: Column, last: Column, several: Column) -> Column:
        """The start only moves on: to the hit itself if its word is an alternative."""
        starts = F.transform(several, lambda g: F.array_min(F.transform(g, lambda j: F.get(last, j))))
        return F.when(e["alone"], e["hit"]).otherwise(F.greatest(acc["begin"], F.array_max(starts)))

    def score(acc: Column, e: Column, last: Column, begin: Column) -> Column:
        words = e["hit"] % _PLACE - begin % _PLACE
        named = F.floor(e["hit"] / _PLACE) - F.floor(begin / _PLACE)
        gain = F.when(
            begin > acc["begin"], F.lit(C.WEIGHT) / (1 + words - named).cast("double")
        ).otherwise(F.lit(0.0))
        return F.struct(
            last.alias("last"), begin.alias("begin"), (acc["score"] + gain).alias("score")
        )

    def step(acc: Column, e: Column, several: Column) -> Column:
        seen = F.transform(
            acc["last"], lambda hit, j: F.when(j + 1 == e["term"], e["hit"]).otherwise(hit)
        )
        return let(
            seen, lambda last: let(latest_start(acc, e, last, several), lambda begin: score(acc, e, last, begin))
        )

    return let(
        F.filter(slots, lambda g: F.size(g) > 1),
        lambda several: F.aggregate(
            hits, state, lambda acc, e: step(acc, e, several), lambda acc: acc["score"]
        ),
    )


def fts_matches(
    queries: DataFrame,
    tokens: DataFrame,
    stats: DataFrame | None = None,
    analyzer: Analyzer = simple_analyzer,
    carry: list[str] = (),
    lead_rows: int = LEAD_ROWS,
    best: int | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, *carry, rank_cd)`` for every chunk a query matches.

    Each alternative is looked up by one lead word that a matching chunk must hold: its rarest
    word when ``stats`` (term, df) is given, else its longest. The other words, phrases and
    exclusions are checked on the chunk's own tokens, so frequent words never produce rows.
    A bounded set of queries is broadcast and chunks are only scanned, a batch at a time; a larger
    one meets the words in a shuffled join of ids. Queries that have ``alternatives`` are taken as
    parsed. With ``best`` a scan may leave out what is not among a query's first ``best`` chunks by
    score (rounded to 12 digits) and id.
    """
    if "alternatives" not in queries.columns:
        queries = parse_queries(queries.select("query_id", "query"), analyzer)
    asked = queries.select("query_id", "alternatives").where(F.size("alternatives") > 0)
    size = asked.agg(F.sum(F.size("alternatives"))).first()[0] or 0
    if size <= lead_rows * LEAD_BLOCKS:
        return _scanned(asked, tokens, stats, carry, best)
    groups = F.transform(F.col("alternatives"), positive_words)
    parsed = asked.select(
        "query_id",
        "alternatives",
        F.array_distinct(F.flatten(groups)).alias("terms"),
        groups.alias("groups"),
        F.posexplode("alternatives").alias("alternative", "items"),
    )
    earlier = F.slice("alternatives", F.lit(1), F.col("alternative"))
    parsed = parsed.select(
        "query_id",
        "terms",
        "groups",
        "alternative",
        "items",
        F.flatten(F.transform(F.filter(earlier, _single), lambda a: a[0]["words"])).alias("words_before"),
        F.filter(earlier, lambda a: ~_single(a)).alias("others_before"),
        positive_words(F.col("items")).alias("_words"),
    )
    if stats is None:
        lead = F.get(
            F.array_sort(
                F.transform(
                    "_words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))
                )
            ),
            F.lit(0),
        )["w"]
        leads = parsed.withColumn("lead", F.coalesce(lead, F.lit("")))
    else:
        rarest = (
            parsed.select("query_id", "alternative", F.explode("_words").alias("term"))
            .join(stats, "term", "left")
            .groupBy("query_id", "alternative")
            .agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("lead"))
        )
        leads = parsed.join(rarest, ["query_id", "alternative"], "left").withColumn(
            "lead", F.coalesce("lead", F.lit(""))
        )
    leads = leads.drop("_words")
    # an alternative made of exclusions only has no lead word: the empty one, which every
    # chunk is given if there is such an alternative
    bare = leads.agg(F.max(F.col("lead") == "")).first()[0]
    words = F.array_distinct(F.array_append("tokens", F.lit("")) if bare else F.col("tokens"))
    ids = tokens.select("chunk_id", F.explode(words).alias("lead")).join(leads, "lead")
    columns = ["chunk_id", *carry]
    return _scored(ids.join(tokens.select(*columns, "tokens"), "chunk_id"), columns)


def _scanned(
    asked: DataFrame, tokens: DataFrame, stats: DataFrame | None, carry: list[str], best: int | None
) -> DataFrame:
    """The matches of queries that fit in a broadcast, from one scan of the chunks."""
    spark, rows = asked.sparkSession, asked.collect()
    frequency = {}
    if stats is not None and rows:
        words = {(w,) for r in rows for items in r["alternatives"] for it in items for w in it["words"]}
        wanted = F.broadcast(spark.createDataFrame(sorted(words), "term string"))
        frequency = {r["term"]: r["df"] for r in stats.join(wanted, "term", "left_semi").select("term", "df").collect()}

    def lead(words: list[str]) -> str:
        return min(words, key=lambda w: (-len(w) if stats is None else frequency.get(w) or 0, w))

    words, queries = C.numbered_queries([r["alternatives"] for r in rows], lead)
    id_type = asked.schema["query_id"].dataType
    ids = pa.array([r["query_id"] for r in rows], to_arrow_type(id_type))
    shared = spark.sparkContext.broadcast((words, ids, queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return C.scan(batches, *shared.value, best)

    chunks = tokens.select("chunk_id", *carry, "tokens")
    hit = StructType([StructField("query_id", id_type), StructField("rank_cd", DoubleType())])
    fields = [*chunks.schema.fields[:-1], StructField("hits", ArrayType(hit))]
    found = chunks.mapInArrow(scan, StructType(fields)).select("chunk_id", *carry, F.explode("hits").alias("hit"))
    return found.select("hit.query_id", "chunk_id", *carry, "hit.rank_cd")


def _scored(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs of a chunk and an alternative in which that is the first one the chunk satisfies."""
    tokens = F.col("tokens")
    found = (
        ~F.arrays_overlap("words_before", tokens)
        & _satisfied(tokens, F.col("items"))
        & ~F.exists("others_before", lambda items: _satisfied(tokens, items))
    )

    # words that the chunk does not hold, and alternatives with one of them, end no stretch
    def slots(present: Column) -> Column:
        held = F.filter("groups", lambda g: (F.size(g) > 0) & (F.size(F.array_except(g, present)) == 0))
        return F.transform(
            held, lambda g: F.transform(g, lambda w: (F.array_position(present, w) - 1).cast("int"))
        )

    density = let(
        F.array_intersect("terms", tokens),
        lambda present: let(slots(present), lambda places: cover_density(tokens, present, places)),
    )
    # generated rather than filtered: a plain filter would become a condition of the join and
    # take the explode above out of generated code, copying the tokens of every word
    scored = pairs.select(
        "query_id", *columns, F.explode_outer(F.array(F.when(found, density))).alias("rank_cd")
    )
    return scored.where(F.col("rank_cd").isNotNull())


def fts_search(
    queries: DataFrame,
    tokens: DataFrame,
    k: int,
    stats: DataFrame | None = None,
    analyzer: Analyzer = simple_analyzer,
    carry: list[str] = (),
) -> DataFrame:
    """The ``k`` best matching chunks per query by cover density; ties go to the smaller id."""
    hits = fts_matches(queries, tokens, stats, analyzer, carry, best=k).withColumn(
        "rank_cd", F.round("rank_cd", 12)
    )
    return top_per_key(
        hits,
        ["query_id"],
        [F.col("rank_cd").desc(), F.col("chunk_id")],
        k,
        salt=F.col("chunk_id"),
    )


Stems = Callable[[DataFrame], DataFrame]


def analysed(
    queries: DataFrame, chunks: DataFrame, stems: Stems, carry: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Queries with ``alternatives`` and a token table, both of analysed words, for ``fts_matches``.

    ``stems`` gives (word, stem) for distinct words, the empty stem for a stop word. It runs once
    over the words of the queries and once over the distinct words of all chunks. A word without a
    stem that some query has is an empty token, so distances are those of the text. Chunks with the
    same id and ``carry`` become one, each of their words behind that of the same position.
    """
    asked = explode_rows(queries, T.tokens(F.col("query")), [], "word").distinct()
    asked = cut_lineage(stems(asked).select("word", "stem"))
    forms = stems(_distinct_words(chunks)).where("stem <> ''").join(asked.select("stem").distinct(), "stem", "left_semi")
    forms = cut_lineage(forms.select("word", "stem"))

    pieces = F.regexp_extract_all(F.col("query"), F.lit(PIECES), F.lit(1))
    rows = explode_rows(queries, pieces, ["query_id"], "piece", "no")
    placed = rows.select("query_id", "no", "piece", F.posexplode_outer(T.tokens(F.col("piece"))).alias("at", "word"))
    stemmed = placed.join(asked, "word", "left").groupBy("query_id", "no", "piece").agg(
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "stem")))).alias("words")
    )
    described = F.struct(
        "no", (F.lower("piece") == "or").alias("split"), F.startswith("piece", F.lit("-")).alias("negated"),
        F.transform("words", lambda w: F.coalesce(w["stem"], F.lit(""))).alias("words"),
    )
    gathered = stemmed.groupBy("query_id").agg(F.array_sort(F.collect_list(described)).alias("_words"))
    parsed = queries.join(gathered, "query_id").select(*queries.columns, _alternatives(F.col("_words")).alias("alternatives"))

    # sent to every executor if bounded
    few = forms.limit(FORM_ROWS + 1).count() <= FORM_ROWS
    keys = ["chunk_id", *carry]
    if few and chunks.groupBy(*keys).count().where("count > 1").isEmpty():
        return parsed, chunks.select(*keys, _stems_of(forms)(T.tokens(F.col("content"))).alias("tokens"))
    return parsed, _gathered_stems(chunks, forms, keys, few)


def _distinct_words(chunks: DataFrame) -> DataFrame:
    """Every word of the chunks once, met in each task before they are shuffled."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.array([], pa.string())
        for batch in batches:
            seen = pa.concat_arrays([seen, batch.column(0).flatten().unique().cast(pa.string())]).unique()
            if len(seen) > FORM_ROWS:
                yield pa.RecordBatch.from_arrays([seen], names=["word"])
                seen = seen.slice(0, 0)
        yield pa.RecordBatch.from_arrays([seen], names=["word"])

    return chunks.select(T.tokens(F.col("content")).alias("words")).mapInArrow(met, "word string").where("word is not null").distinct()


def _stems_of(forms: DataFrame) -> Callable[[Column], Column]:
    """Words of a text as their stems, those that ``forms`` does not have as empty ones."""
    rows = forms.collect()
    shared = forms.sparkSession.sparkContext.broadcast(
        tuple(pa.array([r[name] for r in rows], pa.string()) for name in ("word", "stem")))

    @F.arrow_udf("array<string>")
    def stemmed(words: pa.Array) -> pa.Array:
        known, stems = shared.value
        found = pc.fill_null(stems.take(pc.index_in(words.flatten().cast(pa.string()), value_set=known)), "")
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), found, mask=words.is_null())

    return stemmed


def _gathered_stems(chunks: DataFrame, forms: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """The token table by a join: only words with an asked stem are dealt by chunk."""
    # a last row per chunk tells its number of words and keeps chunks without any asked word
    all_words = F.array_append(T.tokens(F.col("content")), F.lit(""))
    at = explode_rows(chunks, all_words, keys, "word", "at")
    forms = forms.unionAll(forms.sparkSession.createDataFrame([("", "")], "word string, stem string"))
    found = at.join(F.broadcast(forms) if few else forms, "word").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "stem"))).alias("_stems")
    )

    # each word behind as many empty ones as lie between it and the one before; the last row goes
    def placed_word(w: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.get("_stems", i - 1)["at"])
        return F.array_append(F.array_repeat(F.lit(""), w["at"] - before - 1), w["stem"])

    tokens = F.flatten(F.transform("_stems", placed_word))
    tokens = F.slice(tokens, F.lit(1), F.size(tokens) - 1)
    return found.select(*keys, tokens.alias("tokens"))
