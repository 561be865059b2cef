import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from docmill.llm import op7_hmm
from docmill.llm.common import crc_remainder
from docmill.llm.op7_hmm import Model, _stretches, expected_counts, forward_log10, score, words_of


def small(seed=0, states=3, symbols=5):
    r = np.random.default_rng(seed)
    return Model(r.dirichlet(np.ones(states)), r.dirichlet(np.ones(states), states), r.dirichlet(np.ones(symbols), states).T)


def test_forward_and_expected_counts_over_all_paths():
    m, lengths = small(), np.array([4, 1, 6, 2])
    flat = np.random.default_rng(1).integers(0, 5, lengths.sum()).astype(np.uint16)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for at, length, found in zip(np.cumsum(lengths) - lengths, lengths, forward_log10(m, flat, lengths), strict=True):
        seen = flat[at : at + length]
        paths = {}
        for path in itertools.product(range(3), repeat=int(length)):
            p = m.start[path[0]] * m.emit[seen[0], path[0]]
            for t in range(1, length):
                p *= m.move[path[t - 1], path[t]] * m.emit[seen[t], path[t]]
            paths[path] = p
        whole = sum(paths.values())
        assert abs(math.log10(whole) - found) < 1e-9
        for path, p in paths.items():
            start[path[0]] += p / whole
            for t in range(length):
                emit[seen[t], path[t]] += p / whole
                if t:
                    move[path[t - 1], path[t]] += p / whole
    for got, expected in zip(expected_counts(m, flat, lengths), (start, move, emit), strict=True):
        assert np.abs(got - expected).max() < 1e-5


def test_stretches():
    assert _stretches(np.array([512, 513, 1, 1024])).tolist() == [512, 512, 1, 1, 512, 512]


def test_base_score_and_gain_on_held_out_texts(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    found = {r["doc_id"]: r for r in score(docs, crc_remainder("doc_id", 10) == 0, rounds=2).collect()}
    texts = {r["doc_id"]: words_of((r["text"] or "").encode()) for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, words in texts.items() if i not in held for w in words)
    ends = len(texts) - len(held)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    divisor = total + 0.1 * (kinds + 1)
    assert set(found) == set(texts)
    gain = 0
    for i, words in texts.items():
        base = sum(math.log10((counts[w] + 0.1) / divisor) for w in words) + math.log10((ends + 0.1) / divisor)
        r = found[i]
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i in held, len(words) + 1, total)
        assert r["n_known"] == sum(w in counts for w in words) + 1
        gain += (r["score"] - base) * (i in held)
    assert gain > 0


def test_probabilities_of_one_word_texts_sum_to_one(spark):
    """Over all known words and one unknown word for each class, two-token texts have mass below one."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[(i * j) % 40] for j in range(1, 9))) for i in range(1, 60)]
    asked = [(1000 + i, w) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    found = score(docs, docs["doc_id"] >= 1000, states=2, rounds=1).where("doc_id >= 1000").collect()
    assert 0 < sum(10 ** r["score"] for r in found) < 1


def test_awkward_rows(awkward, nothing):
    found = score(awkward, crc_remainder("doc_id", 10) == 0, states=2, rounds=1).collect()
    assert len(found) == awkward.count()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found)
    assert sorted(r["n_tokens"] for r in found)[:4] == [1, 1, 1, 1]
    assert score(nothing, crc_remainder("doc_id", 10) == 0).count() == 0
    held = score(awkward, crc_remainder("doc_id", 10) >= 0, states=2, rounds=1).collect()
    assert {r["n_known"] for r in held} == {0} and all(math.isfinite(r["score"]) for r in held)


def test_groups_are_learnt_from_long_texts_too(spark):
    """The states start from groups of all texts: a kind of text that only comes in long ones has one."""
    docs = [(i, False, (b"red blue " * 40).strip()) for i in range(30)]
    docs += [(100 + i, False, (b"sun moon " * 4_000).strip()) for i in range(3)]
    rows = spark.createDataFrame(docs, "doc_id long, held_out boolean, text binary")
    words = op7_hmm.dictionary(op7_hmm.corpus_counts(rows))
    coded = op7_hmm.encode(rows, words)
    direction, centres = op7_hmm._centres(coded, 2, words.symbols)
    near = [(op7_hmm._points(coded.where(f"doc_id = {i}"), direction).first()["point"]) for i in (0, 100)]
    like = [(np.frombuffer(p, dtype=np.float32) @ centres.T) for p in near]
    assert like[0].argmax() != like[1].argmax() and min(x.max() for x in like) > 0.99


def test_directions_of_long_texts_are_added_up_in_little_memory():
    r = np.random.default_rng(4)
    direction = r.standard_normal((1_000, op7_hmm.DIMS)).astype(np.float32)
    lengths = np.array([1, 9_000, 3, 300_000, 4_096])
    flat = r.integers(0, 1_000, lengths.sum()).astype(np.uint16)
    tracemalloc.start()
    found = op7_hmm._direction_sums(direction, flat, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all directions of the longest text are 77 MB
    for end, length, got in zip(np.cumsum(lengths), lengths, found, strict=True):
        counts = np.bincount(flat[end - length : end], minlength=1_000)
        assert np.abs(counts @ direction.astype(float) - got).max() < 1e-2
    # the hash of a text's direction picks the first centres, so every bit counts
    whole = np.add.reduceat(direction[flat], np.cumsum(lengths) - lengths, axis=0)
    assert whole.tobytes() == found.tobytes()
