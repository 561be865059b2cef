"""Language identification with interpolated Kneser-Ney character models.

Words (runs of letters, lower-cased) are read as characters between a start and an end mark. For
each language the counts of character n-grams are taken by Spark from a bounded sample of labelled
rows, lower orders from continuation counts, and become interpolated probabilities and back-off
weights. All n-grams of an order lie in one sorted array of 64-bit hashes with one column per
language, so one binary search serves every language. The language with the lowest cross-entropy
per character wins. Other rows of the sample, never counted, calibrate the rejection. Entropies of
short texts scatter more, with the root of their length, so a text of n letters is rejected if its
cross-entropy exceeds ``MARGIN`` times (median + ``WIDE`` * spread / sqrt(n)); the spread is the 90 %
quantile of (entropy - median) * sqrt(letters), so up to a tenth of mislabelled rows does not widen it.

The model holds every n-gram of the sample. It grows with the number of languages, not with the rows.

Defined cases: null and empty texts and texts without a letter are ``und`` with score 0 and
rejected; texts with fewer than ``SHORT`` letters are never rejected otherwise; ties go to the
language first in order; words of more than ``PIECE`` letters are read in pieces; repeated rows are
predicted alike and count once in the sample; a language with fewer than ``RARE`` sampled rows counts them
all, and no text is rejected in it; without any training row every text is ``und``. Columns other than text (and
the language of training rows) take no part in a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from docmill.llm.common import stored, text_batches

ORDER = 4
SAMPLE_ROWS = 1_500  # labelled rows of each language that are counted or calibrate
SAMPLE_CHARS = 8_000_000  # and their characters: a text that begins beyond is not sampled
CALIBRATION = 5  # one sample row in so many calibrates
RARE = 10
MARGIN = 1.6
WIDE = 3.0
SHORT = 20
SHARPNESS = 10.0
PIECE = 1_000
KNOWN_WORDS = 200_000
BLOCK = 1 << 18
START, END = "\x02", "\x03"
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    if not all(map(str.isalpha, found)):  # numbers that are not digits, like a superscript
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of a string from the hash of all but its first character and that character."""
    x = (hashes ^ (codes.astype(np.uint64) * _MUL)) * _MUL2
    return x ^ (x >> np.uint64(29))


def gram_hashes(grams: list[str]) -> np.ndarray:
    """Hashes of strings of one length."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).reshape(len(grams), -1)
    out = np.zeros(len(grams), dtype=np.uint64)
    for column in range(codes.shape[1] - 1, -1, -1):
        out = _extend(out, codes[:, column])
    return out


@dataclass
class Model:
    languages: list[str]
    hashes: list[np.ndarray]  # by order, sorted
    logp: list[np.ndarray]  # n-gram x language, nan where not seen
    backoff: list[np.ndarray]  # of the n-gram as a context; 0 where not seen
    empty: np.ndarray  # log probability of a character never seen, by language
    limits: np.ndarray  # cross-entropy above which a long text is rejected
    spread: np.ndarray  # what is added for shorter texts, times the root of their letters

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        at = 0
        while at < len(words):
            size, stop = 0, at
            while stop < len(words) and (stop == at or size + len(words[stop]) + 2 <= BLOCK):
                size += len(words[stop]) + 2
                stop += 1
            out[at:stop] = self._score(words[at:stop])
            at = stop
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        text = START + (END + START).join(words) + END
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        total = np.broadcast_to(self.empty, (len(codes), len(self.empty))).copy()
        hashes = np.zeros(len(codes), dtype=np.uint64)
        context = None
        for order, table in enumerate(self.hashes, 1):
            # hash of the n-gram that ends here = hash of the (n-1)-gram that ends here + first char
            first = np.concatenate([np.zeros(order - 1, dtype=np.uint32), codes[: len(codes) - order + 1]])
            hashes = _extend(hashes, first)
            at = np.minimum(np.searchsorted(table, hashes), max(len(table) - 1, 0))
            found = (place >= order - 1) & (table[at] == hashes) if len(table) else np.zeros(len(codes), bool)
            if context is not None:
                total += context
            rows = np.flatnonzero(found)
            logp = self.logp[order - 1][at[rows]]
            total[rows] = np.where(np.isnan(logp), total[rows], logp)
            context = np.zeros_like(total)
            ends = rows[rows + 1 < len(codes)]
            context[ends + 1] = self.backoff[order - 1][at[ends]]
            context[place < order] = 0
        total[starts] = 0
        return np.add.reduceat(total, starts, axis=0)


def _word_counts(batches):
    from collections import Counter

    for batch in text_batches(batches, 500, 4 << 20):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, word, n) for lang, found in counts.items() for word, n in found.items()]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
            pa.array([r[2] for r in rows], pa.int64()),
        ], names=["lang", "word", "n"])


def _grams(words: DataFrame, order: int) -> DataFrame:
    """lang, gram, n: raw counts of the n-grams that predict a character, cut at the start mark."""
    marked = F.concat(F.lit(START), "word", F.lit(END))
    gram = F.transform(
        F.sequence(F.lit(2), F.length("word") + 2),
        lambda i: F.substring(F.col("marked"), F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order))),
    )
    rows = words.withColumn("marked", marked).select("lang", "n", F.explode(gram).alias("gram"))
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          order: int = ORDER, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Model of the languages in ``docs``. Of each language up to ``sample_rows`` rows are read, those
    with the smallest hash of id and length, as long as those before hold fewer than ``sample_chars``
    characters; their texts are read whole. ``lang`` has as many values as there are languages."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.col(text_col) != ""))
    rows = rows.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("_pick"),
    )
    # the last place of each language's sample is found without the texts; of a frequent language only
    # about twice the sample comes together
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_pick").alias("_n"))
    whole = 1 << 40
    share = F.when(F.col("_n") > 4 * sample_rows, (2 * sample_rows * whole / F.col("_n")).cast("long")).otherwise(whole)
    few = rows.select("lang", "_pick", "id", F.length("text").alias("size")).join(F.broadcast(counts), "lang")
    few = few.where(F.pmod(F.xxhash64("_pick"), F.lit(whole)) < share).groupBy("lang", "_pick", "id").agg(F.max("size").alias("size"))
    place = Window.partitionBy("lang").orderBy("_pick", "id")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_at", F.row_number().over(place)).withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    few = few.where((F.col("_at") <= sample_rows) & (F.col("_before") < sample_chars)).select("lang", "_pick", "id")
    sample = F.broadcast(few.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("lang"))).select(
        F.col("lang").alias("_lang"), F.col("_pick").alias("_p"), F.col("id").alias("_i"), "_rows"
    ))
    same = (F.col("lang") == F.col("_lang")) & (F.col("_pick") == F.col("_p")) & F.col("id").eqNullSafe(F.col("_i"))
    rows = rows.join(sample, same).dropDuplicates(["lang", "_pick", "id", "text"])
    calibrates = (F.pmod("_pick", F.lit(CALIBRATION)) == 0) & (F.col("_rows") >= RARE)
    rows = stored(rows.select("lang", "text", calibrates.alias("calibrates")))
    counted = rows.where(~F.col("calibrates"))
    words = counted.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    raw = stored(_grams(words, order))
    levels = {order: raw.where(F.length("gram") == order)}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(
            F.count(F.lit(1)).alias("n")
        )
        cut = raw.where((F.length("gram") == k) & F.col("gram").startswith(START))
        levels[k] = stored(shorter.unionByName(cut).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = levels[order]
    for k in range(1, order):
        table = table.unionByName(levels[k])
    model = _estimate([tuple(r) for r in table.collect()], order)
    if not model.languages:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)
    checked = rows.where("calibrates").select("lang", "text").mapInArrow(
        lambda batches: _entropies(batches, sent.value), "lang string, entropy double, letters long"
    )
    checked = stored(checked.where(F.col("letters") >= 2 * SHORT))
    middle = checked.groupBy("lang").agg(F.percentile("entropy", 0.5).alias("middle"))
    off = F.greatest(F.col("entropy") - F.col("middle"), F.lit(0.0)) * F.sqrt("letters")
    found = checked.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("middle").alias("middle"), F.percentile(off, 0.9).alias("spread")
    ).collect()
    middle = {r["lang"]: r["middle"] for r in found}
    spread = {r["lang"]: r["spread"] for r in found}
    model.limits = np.array([MARGIN * middle.get(lang, np.inf) for lang in model.languages])
    model.spread = np.array([MARGIN * WIDE * spread.get(lang, 0.0) for lang in model.languages])
    return model


def _estimate(rows: list[tuple[str, str, int]], order: int) -> Model:
    """Interpolated probabilities and back-off weights from (language, n-gram, count)."""
    languages = sorted({r[0] for r in rows})
    column = {lang: i for i, lang in enumerate(languages)}
    size = len(languages)
    empty = np.zeros(size)
    hashes, logps, backoffs = [], [], []
    lower: dict[tuple[int, str], float] = {}
    by_order: list[list[tuple[int, str, int]]] = [[] for _ in range(order + 1)]
    for lang, gram, n in rows:
        by_order[len(gram)].append((column[lang], gram, n))
    weights: dict[tuple[int, str], float] = {}
    for k in range(1, order + 1):
        ones, twos = np.zeros(size), np.zeros(size)
        totals: dict[tuple[int, str], list[float]] = {}
        for lang, gram, n in by_order[k]:
            ones[lang] += n == 1
            twos[lang] += n == 2
            context = totals.setdefault((lang, gram[:-1]), [0, 0])
            context[0] += n
            context[1] += 1
        discount = np.clip(np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.9)
        for (lang, context), (total, kinds) in totals.items():
            weights[lang, context] = discount[lang] * kinds / total
        if k == 1:
            characters = max(len({gram for _, gram, _ in by_order[1]}) + 1, 2)
            uniform = 1 / characters
            for lang in range(size):
                empty[lang] = np.log(weights.get((lang, ""), 1.0) * uniform)
        now = {}
        for lang, gram, n in by_order[k]:
            total = totals[lang, gram[:-1]][0]
            below = lower.get((lang, gram[1:]))
            if below is None:
                below = np.exp(empty[lang]) if k > 1 else uniform
            now[lang, gram] = (n - discount[lang]) / total + weights[lang, gram[:-1]] * below
        lower = now
        by_order[k] = list(now.items())
    for k in range(1, order + 1):
        grams = sorted({gram for (_, gram), _ in by_order[k]} | {g for _, g in weights if len(g) == k})
        keys = gram_hashes(grams) if grams else np.empty(0, dtype=np.uint64)
        turn = np.argsort(keys)
        row = {grams[g]: i for i, g in enumerate(turn)}
        logp = np.full((len(grams), size), np.nan)
        backoff = np.zeros((len(grams), size))
        for (lang, gram), p in by_order[k]:
            logp[row[gram], lang] = np.log(p)
        for (lang, gram), weight in weights.items():
            if len(gram) == k:
                backoff[row[gram], lang] = np.log(weight)
        hashes.append(keys[turn])
        logps.append(logp)
        backoffs.append(backoff)
    return Model(languages, hashes, logps, backoffs, empty, np.full(size, np.inf), np.zeros(size))


class Reader:
    """Scores texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((KNOWN_WORDS, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, and its letters (0: no prediction)."""
        flat: list[str] = []
        ends, letters = [], []
        for text in texts:
            found = words_of(text) if text else []
            flat += found
            ends.append(len(flat))
            letters.append(sum(map(len, found)))
        new = list(set(flat).difference(self.known))
        if len(self.known) + len(new) > len(self.table):
            self.known = {}
            new = list(set(flat))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.table.shape[1]))
        start = len(self.known)
        if new:
            self.table[start : start + len(new)] = self.model.score(new)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        ends = np.array(ends, dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sums = np.zeros((len(texts), self.table.shape[1]))
        some = np.flatnonzero(ends > begins)
        if len(some):
            sums[some] = np.add.reduceat(self.table[at], begins[some], axis=0)
        letters = np.array(letters)
        characters = letters + (ends - begins)
        return -sums / np.maximum(characters, 1)[:, None], letters


def _entropies(batches, model: Model):
    read = Reader(model)
    column = {lang: i for i, lang in enumerate(model.languages)}
    for batch in text_batches(batches, 500, 4 << 20):
        entropy, letters = read(batch.column(1).to_pylist())
        langs = batch.column(0).to_pylist()
        own = [entropy[i, column[lang]] if lang in column else None for i, lang in enumerate(langs)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(own, pa.float64()), pa.array(letters, pa.int64())],
            names=["lang", "entropy", "letters"],
        )


MADE = ("lang_pred", "score", "entropy", "rejected")


def identify(docs: DataFrame, model: Model, text_col: str = "text", passed: list[str] | None = None,
             made: tuple[str, str, str, str] = MADE) -> DataFrame:
    """The ``passed`` columns of every row (all, if not named) with ``lang_pred``, ``score`` (share
    of the winner, 0 to 1), ``entropy`` (per character, in nats) and ``rejected``; ``made`` gives
    these four other names where passed columns bear them."""
    passed = docs.columns if passed is None else passed
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in passed] + [
        T.StructField(made[0], T.StringType()), T.StructField(made[1], T.DoubleType()),
        T.StructField(made[2], T.DoubleType()), T.StructField(made[3], T.BooleanType()),
    ])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        read = Reader(sent.value) if sent.value.languages else None
        for batch in text_batches(batches, 2_000, 4 << 20, column=0):
            values = _predict(sent.value, read, batch.column(0).to_pylist())
            kept = [batch.column(i + 1).cast(arrow.field(i).type) for i in range(len(passed))]
            kept += [pa.array(v, type=arrow.field(len(passed) + i).type) for i, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays(kept, schema=arrow)

    source = docs.select(F.col(text_col).alias("_text"), *[F.col(c) for c in passed])
    return source.mapInArrow(work, schema)


def _predict(model: Model, read: Reader | None, texts: list[str | None]):
    n = len(texts)
    if read is None:
        return [UNKNOWN] * n, [0.0] * n, [None] * n, [True] * n
    entropy, letters = read(texts)
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(n), best]
    share = 1 / np.exp(-SHARPNESS * (entropy - least[:, None])).sum(axis=1)
    some = letters > 0
    limit = model.limits[best] + model.spread[best] / np.sqrt(np.maximum(letters, 1))
    rejected = ~some | ((letters >= SHORT) & (least > limit))
    return (
        [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)],
        np.where(some, share, 0.0).tolist(),
        [float(x) if s else None for x, s in zip(least, some, strict=True)],
        rejected.tolist(),
    )
