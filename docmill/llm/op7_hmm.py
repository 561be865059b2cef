"""Hidden Markov language model: Baum-Welch over the partitions, exact likelihood by the scaled
forward recursion.

Words of any number are emitted through a bounded alphabet: each of the most frequent words is a
symbol of its own, every other word falls into a class by its ending, and the end of a text is a
symbol. A state emits symbols; within a class a word has its smoothed share of the class's corpus
count, one further share standing for all words not seen. So the model is one table of
symbols x states, whatever the corpus, and the likelihood of a text is the forward recursion over
its symbols times the shares of its words.

Corpus counts are taken over all training texts: combined in each task, then by word. A dictionary
of the most frequent words, bounded in number and length, goes to the workers; counts of all other
words come by a join on the word. Expected counts are summed in each task and then by symbol.
States start as groups of similar texts; the groups, the first counts and every Baum-Welch round cover
all training texts, long texts in stretches of ``STRETCH`` tokens. Scoring
follows each text from its first token to its end.

Defined cases: a null or empty text is its end token alone; without training texts all words share
one class, so that a score is finite; rows are scored each on its own, repeated or not; a row with a
null id is held out. Other columns take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill.llm.common import stored, text_batches

STATES = 8
HEAD = 200_000  # words in the dictionary sent to the workers
HEAD_BYTES = 64  # and the longest such word
OWN = 32_768  # dictionary words that are symbols of their own
CLASSES = 16_384
ROUNDS = 3
STRETCH = 512
GROUP_ROUNDS = 20  # at most, for the groups of texts that the states start from
SMOOTHING = 200.0  # tokens' worth of the symbol's corpus share in each state
COUNTED = 400_000  # words counted in a task before they are passed on
BATCH_TOKENS = 1 << 18
DIMS = 64
DIRECTIONS = 4_096  # directions of symbols held at a time
ADD = 0.1  # of the base model


def words_of(text: bytes | None) -> list[bytes]:
    """Stretches without ASCII white space, A-Z lower-cased: what these methods of bytes do."""
    return text.lower().split() if text else []


def _word_counts(batches):
    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            words = words_of(text.as_py())
            for at in range(0, len(words), COUNTED):
                counts.update(words[at : at + COUNTED])
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts = Counter()
    yield rows(counts)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


@dataclass
class Dictionary:
    """The most frequent words with their counts, and the classes' totals."""

    words: list[bytes]
    counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray

    @property
    def own(self) -> int:
        return min(OWN, len(self.words))

    @property
    def symbols(self) -> int:
        return OWN + CLASSES + 1

    def log_shares(self) -> np.ndarray:
        """log10 of the divisor of a class's shares."""
        return np.log10(self.class_counts + ADD * (self.class_words + 1))


def corpus_counts(texts: DataFrame) -> DataFrame:
    """word, c over the column ``text`` (bytes)."""
    counted = texts.select("text").mapInArrow(_word_counts, "word binary, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("c")))


def dictionary(counts: DataFrame) -> Dictionary:
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    # counts in steps: each up to 1,000, then eight for a doubling; the dictionary takes whole steps,
    # so that no task sends words which are not in it
    step = F.when(F.col("c") <= 1_000, F.col("c")).otherwise(F.floor(F.log2("c") * 8) + 1_000)
    found = short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 0, 0
    for row in sorted(found, key=lambda r: -r["step"]):
        held += row["n"]
        if held > HEAD:
            least = row["step"] + 1
            break
    top = short.where(step >= least).collect()
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in top]
    own = set(words[:OWN])
    sent = counts.sparkSession.sparkContext.broadcast(own)

    def classes(batches):
        total, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in sent.value:
                    total[word_class(word)] += c
                    kinds[word_class(word)] += 1
        some = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(kinds[some])],
                                         names=["class", "c", "v"])

    found = counts.select("word", "c").mapInArrow(classes, "class long, c long, v long")
    found = found.groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    class_counts, class_words = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for row in found:
        class_counts[row["class"]], class_words[row["class"]] = row["c"], row["v"]
    return Dictionary(words, np.array([r["c"] for r in top], dtype=np.int64), class_counts, class_words)


def encode(docs: DataFrame, words: Dictionary) -> DataFrame:
    """Symbols of every text (16-bit numbers, the end symbol last), sums over its dictionary words,
    and its other words. ``docs`` has doc_id, held_out and text (bytes)."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("symbols", T.BinaryType()),
        T.StructField("head_known", T.LongType()), T.StructField("head_log", T.DoubleType()),
        T.StructField("share_log", T.DoubleType()), T.StructField("rare", T.ArrayType(T.BinaryType())),
    ])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        known = sent.value
        place = {word: i for i, word in enumerate(known.words)}
        logs = np.log10(known.counts + ADD) if len(known.words) else np.zeros(1)
        divisors = known.log_shares()
        symbol = np.arange(max(len(known.words), 1), dtype=np.int64)
        for i in range(OWN, len(known.words)):
            symbol[i] = OWN + word_class(known.words[i])
        share = np.where(symbol < OWN, 0.0, logs - divisors[np.maximum(symbol - OWN, 0)])
        for batch in text_batches(batches, 2_000, 4 << 20, column=2):
            columns = [[] for _ in range(6)]
            for text in batch.column(2):
                values = _encode_text(words_of(text.as_py()), place, symbol, logs, share, divisors)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            arrays = [batch.column(0).cast(arrow.field(0).type), batch.column(1)]
            arrays += [pa.array(c, type=arrow.field(i + 2).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    coded = docs.select("doc_id", "held_out", "text").mapInArrow(work, schema)
    return stored(coded.withColumn("row", F.monotonically_increasing_id()))


def _encode_text(words, place, symbol, logs, share, divisors):
    at = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    out = np.empty(len(words) + 1, dtype=np.uint16)
    out[-1] = OWN + CLASSES
    out[:-1] = symbol[at]
    unknown = np.flatnonzero(at < 0)
    rare = [words[i] for i in unknown]
    classes = np.fromiter(map(word_class, rare), dtype=np.int64, count=len(rare))
    out[unknown] = OWN + classes
    known = at[at >= 0]
    shares = share[known].sum() - divisors[classes].sum()
    return len(out), out.tobytes(), len(known), float(logs[known].sum()), float(shares), rare


@dataclass
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # symbol x state


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols behind each other, and their number in each text."""
    lengths = np.fromiter((len(x.as_buffer()) for x in column), dtype=np.int64, count=len(column)) // 2
    flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in column])
    return flat, lengths


def forward_log10(model: Model, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence; all sequences go forward together, the long ones last."""
    starts = np.cumsum(lengths) - lengths
    turn = np.argsort(-lengths, kind="stable")
    starts, length = starts[turn], lengths[turn]
    total = np.zeros(len(lengths))
    active = len(lengths)
    alpha = np.broadcast_to(model.start, (active, len(model.start)))
    for t in range(int(length[0]) if len(length) else 0):
        while length[active - 1] <= t:
            active -= 1
        alpha = alpha[:active] @ model.move if t else alpha[:active]
        alpha = alpha * model.emit[flat[starts[:active] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:active] += np.log10(scale)
    out = np.empty(len(lengths))
    out[turn] = total
    return out


def expected_counts(model: Model, flat: np.ndarray, lengths: np.ndarray):
    """Expected starts, moves and emissions (symbol x state) of the sequences."""
    starts = np.cumsum(lengths) - lengths
    turn = np.argsort(-lengths, kind="stable")
    starts, length = starts[turn], lengths[turn]
    k, steps = len(model.start), int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    behind = np.cumsum(active)
    # symbols in the order of the steps, so that a step's rows lie together
    step = np.repeat(np.arange(steps), active)
    flat = flat[starts[np.arange(len(flat)) - (behind - active)[step]] + step]
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    gives = emit[flat]
    alphas = np.empty((len(flat), k), dtype=np.float32)
    scales = np.empty((len(flat), 1), dtype=np.float32)
    alpha = np.broadcast_to(model.start.astype(np.float32), (len(length), k))
    at = 0
    for t in range(steps):
        n = active[t]
        end = at + n
        now = alphas[at:end]
        np.multiply(alpha[:n] @ move if t else alpha[:n], gives[at:end], out=now)
        scale = now.sum(axis=1, keepdims=True, out=scales[at:end])
        now /= scale
        alpha, at = now, end
    moves = np.zeros((k, k))
    states = np.empty((len(flat), k), dtype=np.float32)
    beta = np.ones((active[-1], k), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        n, end = active[t], behind[t]
        at = end - n
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), k), dtype=np.float32)])
        gamma = np.multiply(alphas[at:end], beta, out=states[at:end])
        gamma /= gamma.sum(axis=1, keepdims=True)
        if t:
            ahead = gives[at:end] * beta
            ahead /= scales[at:end]
            first = at - active[t - 1]
            moves += alphas[first : first + n].T @ ahead
            beta = ahead @ move.T
    moves *= model.move
    symbols = np.stack([np.bincount(flat, weights=states[:, i], minlength=len(model.emit)) for i in range(k)], axis=1)
    return states[: active[0]].sum(axis=0), moves, symbols


def _stretches(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the pieces of at most STRETCH tokens that the texts are cut into."""
    whole, rest = lengths // STRETCH, lengths % STRETCH
    pieces = np.full(int((whole + (rest > 0)).sum()), STRETCH, dtype=np.int64)
    last = np.cumsum(whole + (rest > 0)) - 1
    pieces[last[rest > 0]] = rest[rest > 0]
    return pieces


def _summed(coded: DataFrame, states: int, symbols: int, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``count(flat, lengths)`` over all texts of ``coded``: each task adds up its own, then
    the rows meet by symbol. Starts and moves are rows behind the symbols."""
    names = [f"s{i}" for i in range(states)]

    def work(batches):
        total = np.zeros((symbols + 1 + states, states))
        for batch in text_batches(batches, 1_000, 2 * BATCH_TOKENS, column=0):
            start, moves, emitted = count(*_unpacked(batch.column(0)))
            total[:symbols] += emitted
            total[symbols] += start
            total[symbols + 1 :] += moves
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(total[some, i]) for i in range(states)],
                                         names=["symbol", *names])

    schema = "symbol long, " + ", ".join(f"{n} double" for n in names)
    rows = coded.select("symbols").mapInArrow(work, schema)
    rows = rows.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).collect()
    total = np.zeros((symbols + 1 + states, states))
    for row in rows:
        total[row["symbol"]] = row[1:]
    return total[symbols], total[symbols + 1 :], total[:symbols]


def _estimate(start, moves, emitted) -> Model:
    """Smoothed probabilities from expected counts."""
    share = (emitted.sum(axis=1) + 0.5) / (emitted.sum() + 0.5 * len(emitted))
    emit = (emitted + SMOOTHING * share[:, None]) / (emitted.sum(axis=0) + SMOOTHING)
    k = len(start)
    move = (moves + 1.0 / k) / (moves.sum(axis=1, keepdims=True) + 1.0)
    return Model((start + 1.0 / k) / (start.sum() + 1.0), move, emit)


def _centres(coded: DataFrame, states: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the symbols, and the middle of each of ``states`` groups of similar texts: k-means
    over the directions of all texts. A task hands on one row per group and round."""
    random = np.random.default_rng(7)
    direction = random.standard_normal((symbols, DIMS)).astype(np.float32)
    direction[-1] = 0
    points = stored(_points(coded, direction))
    picked = points.select("point", F.xxhash64("point").alias("pick")).orderBy("pick").limit(states).collect()
    if not picked:
        return direction, np.zeros((states, DIMS), dtype=np.float32)
    found = np.stack([np.frombuffer(r["point"], dtype=np.float32) for r in picked])
    found = np.unique(found, axis=0)
    centres = np.zeros((states, DIMS), dtype=np.float32)
    centres[: len(found)] = found
    used = len(found)
    for _ in range(GROUP_ROUNDS):
        rows = _groups(points, centres[:used])
        now = np.zeros_like(centres)
        for i, (_, middle) in rows.items():
            now[i] = middle / max(np.linalg.norm(middle), 1e-9)
        # a group without texts starts again from the text that is least like its own group
        far = sorted(least for least, _ in rows.values())
        spare = [i for i in range(states) if i not in rows]
        for i, (like, point) in zip(spare, far, strict=False):
            if like < 0.999:
                now[i] = np.frombuffer(point, dtype=np.float32)
        used = int(np.flatnonzero(now.any(axis=1)).max(initial=0)) + 1
        moved, centres = np.abs(now - centres).max(), now
        if moved < 1e-3:
            break
    return direction, centres


def _direction_sums(direction: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of its symbols' directions for each text. Few texts at a time are turned, so that the numbers
    of a component lie together and stay in the processor's cache; a long text is added up by component."""
    ends = np.cumsum(lengths)
    starts, sums, at = ends - lengths, np.empty((len(lengths), DIMS), dtype=np.float32), 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + DIRECTIONS, side="right")))
        part = flat[starts[at] : ends[stop - 1]]
        if len(part) <= DIRECTIONS:
            turned = np.ascontiguousarray(direction[part].T)
            sums[at:stop] = np.add.reduceat(turned, starts[at:stop] - starts[at], axis=1).T
        else:
            sums[at] = [np.add.reduceat(direction[part, i], [0])[0] for i in range(DIMS)]
        at = stop
    return sums


def _points(coded: DataFrame, direction: np.ndarray) -> DataFrame:
    """The direction of every text: the sum of its symbols' directions, of length 1."""
    sent = coded.sparkSession.sparkContext.broadcast(direction)

    def work(batches):
        for batch in text_batches(batches, 1_000, 2 * BATCH_TOKENS, column=0):
            flat, lengths = _unpacked(batch.column(0))
            sums = _direction_sums(sent.value, flat, lengths)
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sums], pa.binary())], names=["point"])

    return coded.select("symbols").mapInArrow(work, "point binary")


def _groups(points: DataFrame, centres: np.ndarray) -> dict[int, tuple[tuple[float, bytes], np.ndarray]]:
    """Per group with texts: the text least like its centre, and the sum of its texts."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def work(batches):
        k = len(sent.value)
        sums, least = np.zeros((k, DIMS)), [(2.0, b"")] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.stack([np.frombuffer(x.as_buffer(), dtype=np.float32) for x in batch.column(0)])
            like = flat @ sent.value.T
            near = like.argmax(axis=1)
            like = like[np.arange(len(near)), near]
            for i in np.unique(near):
                mine = np.flatnonzero(near == i)
                sums[i] += flat[mine].sum(axis=0)
                one = mine[like[mine].argmin()]
                least[i] = min(least[i], (float(like[one]), flat[one].tobytes()))
        some = [i for i in range(k) if least[i][1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([least[i][0] for i in some], pa.float64()),
             pa.array([least[i][1] for i in some], pa.binary()), pa.array([sums[i].tobytes() for i in some], pa.binary())],
            names=["state", "like", "point", "sums"])

    found = {}
    for row in points.mapInArrow(work, "state long, like double, point binary, sums binary").collect():
        least, sums = found.get(row["state"], ((2.0, b""), 0.0))
        least = min(least, (row["like"], bytes(row["point"])))
        found[row["state"]] = least, sums + np.frombuffer(row["sums"], dtype=np.float64)
    return found


def train(coded: DataFrame, words: Dictionary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Model of the encoded training texts."""
    symbols = words.symbols
    direction, centres = _centres(coded, states, symbols)
    context = coded.sparkSession.sparkContext
    sent = context.broadcast((direction, centres))

    def first(flat, lengths):
        direction, centres = sent.value
        sums = _direction_sums(direction, flat, lengths)
        state = (sums @ centres.T).argmax(axis=1)
        start = np.bincount(state, minlength=states).astype(float)
        each = np.repeat(state, lengths)
        emitted = np.bincount(flat.astype(np.int64) * states + each, minlength=symbols * states)
        tokens = np.bincount(each, minlength=states)
        moves = np.diag(tokens * 0.95) + tokens[:, None] * 0.05 / states
        return start, moves, emitted.reshape(symbols, states).astype(float)

    model = _estimate(*_summed(coded, states, symbols, first))
    for _ in range(rounds):
        now = context.broadcast(model)

        def round_(flat, lengths, now=now):
            return _expected_in_blocks(now.value, flat, _stretches(lengths))

        model = _estimate(*_summed(coded, states, symbols, round_))
    return model


def _expected_in_blocks(model, flat, lengths):
    ends = np.cumsum(lengths)
    start, total = 0, None
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_TOKENS, side="right")))
        found = expected_counts(model, flat[base : ends[stop - 1]], lengths[start:stop])
        total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
        start = stop
    return total


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; the
    rows that are not held out are learnt from."""
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    learnt = source.where(~F.col("held_out"))
    counts = corpus_counts(learnt)
    words = dictionary(counts)
    coded = encode(source, words)
    ends = coded.where(~F.col("held_out")).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = sums[0] + ends, sums[1] + (ends > 0)
    model = train(coded.where(~F.col("held_out")), words, states, rounds)
    rare = _rare_sums(coded, counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def likelihood(batches):
        for batch in text_batches(batches, 10_000, 32 << 20, column=1):
            logs = forward_log10(sent.value, *_unpacked(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs)], names=["row", "forward"])

    forward = coded.select("row", "symbols").mapInArrow(likelihood, "row long, forward double")
    parts = coded.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "share_log")
    joined = parts.join(forward, "row").join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    end_log = float(np.log10(ends + ADD))
    divisor = float(np.log10(tokens + ADD * (kinds + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log + end_log - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("forward") + F.col("share_log") + rare_log).alias("score"),
    )


def _rare_sums(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum of log10(c + 0.1), and the number of words with a count, over each row's words outside
    the dictionary."""
    rare = coded.select("row", F.explode("rare").alias("word"))
    joined = rare.join(counts, "word", "left")
    return joined.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("rare_log"),
        F.count("c").alias("rare_known"),
    )
