import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docmill.llm import op13_packing as P
from docmill.llm.queries import byte_tokenizer, packing_query


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(byte_tokenizer())
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, P.END]


def plain_first_fit(lengths, width):
    rooms, places = [], {}
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for s, room in enumerate(rooms):
            if room >= lengths[item]:
                break
        else:
            s = len(rooms)
            rooms.append(width)
        places[item] = (s, width - rooms[s])
        rooms[s] -= lengths[item]
    return [places[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(20))
def test_tree_equals_plain_first_fit(seed):
    dice = random.Random(seed)
    lengths = [dice.randint(1, dice.choice([8, 40, 63])) for _ in range(dice.randint(1, 300))]
    assert P.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)


@pytest.mark.parametrize("lengths", [[5], [40] * 200, [33, 31] * 9, list(range(1, 64)), [32, 16, 8], [63] * 3])
def test_group_is_whole_and_tight(lengths):
    pieces = P.pack_group(lengths, 64, 1)
    covered, filled = defaultdict(list), defaultdict(list)
    for item, start, length, sequence, offset in pieces:
        covered[item].append((start, length))
        filled[sequence].append((offset, length))
    for item, length in enumerate(lengths):
        assert sum(n for _, n in covered[item]) == length
        assert [a for a, _ in sorted(covered[item])] == list(np.cumsum([0] + [n for _, n in sorted(covered[item])])[:-1])
    loose = 0
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
        loose += P.padding(int(ends[-1]), 64) > 1
    assert loose <= 1


def test_stretches_tokenize_as_the_whole(plain, monkeypatch):
    text = " ".join(["word", "café's", "12,5", "  two", "line\n\nnext", "<|endoftext|>", "日本", "x" * 150, "\x1c \x85 a"] * 40)
    assert len(list(P.slices(text, 37))) > 20 and "".join(P.slices(text, 37)) == text
    monkeypatch.setattr(P, "SLICE", 37)
    monkeypatch.setattr(P, "KNOWN", 20)
    ids = P.Ids(P.read_tokenizer(byte_tokenizer()))
    dice = random.Random(1)
    odd = [chr(c) for c in [*range(0x20), 0x20, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F,
                            0x2060, 0x3000, 0xFEFF, 0x301]] + list("abst1.,'é日ªд²ñ×_ \n\t  ") * 3
    texts = [text, "", "short", " ", "x \n "] + ["".join(dice.choices(odd, k=dice.randint(1, 40))) for _ in range(3_000)]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for t, found in zip(part, ids.of(part), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == plain(t)[:-1], repr(t)
    whole = "".join(texts)
    assert np.frombuffer(next(ids.of([whole])), "<u4").tolist() == plain(whole)[:-1]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_equals_tokenizer(spark, root, plain):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing_query(spark, root).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids, at = np.array(plain(texts[doc_id]), dtype="<u4"), 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    filled = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        filled.append(at)
    assert sum(P.padding(n, 2048) for n in filled) <= len(filled) * P.SLACK + 2048


def test_sequences_hold_the_texts(spark, plain):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(i * 7))) for i in range(60)], "doc_id long, text string")
    packed = P.pack_documents(docs, byte_tokenizer(), width=64, group=10, slack=1)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    rows = {r.sequence_id: r for r in P.sequences(packed, 64, pad=0).collect()}
    ids = defaultdict(list)
    for r in packed.orderBy("doc_id", "start").collect():
        ids[r.doc_id] += rows[r.sequence_id].ids[r.offset : r.offset + r.length]
    assert {i: plain(t) for i, t in docs.collect()} == ids
    assert all(len(r.ids) == r.used + P.padding(r.used, 64) for r in rows.values())
    assert sum(r.used for r in rows.values()) == sum(map(len, ids.values()))


def test_awkward(spark, awkward, nothing, plain):
    found = P.pack_documents(awkward, byte_tokenizer()).select("doc_id", "start", "length", "doc_tokens").collect()
    sizes = sorted(len(plain(r.text)) for r in awkward.collect())
    assert sum(r.length for r in found) == sum(sizes)
    assert sorted(r.doc_tokens for r in found if r.start == 0) == sizes
    assert {r.doc_id for r in found} == {r.doc_id for r in awkward.collect()}
    assert P.pack_documents(nothing, byte_tokenizer()).count() == 0


def test_equal_rows_part(spark):
    docs = spark.createDataFrame([(1, "the same text again and again")] * 3_000, "doc_id long, text string")
    pieces = P.pack_documents(docs, byte_tokenizer(), group=100).collect()
    groups = defaultdict(int)
    for r in pieces:
        groups[r.sequence_id >> 25] += 1
    assert len(groups) >= 25 and max(groups.values()) < 200
