import hashlib
import random
import struct

import pytest

from docmill.llm.op10_sentencepiece import PieceTable, encode, encode_digests, read_model
from docmill.llm.queries import vocabulary

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary())


@pytest.fixture(scope="module")
def table():
    return PieceTable(read_model(vocabulary()))


def ids(table, text):
    packed = table.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def same(table, library, text):
    expected = library.encode(text, add_bos=True, add_eos=True)
    assert ids(table, text) == expected
    assert table.decode(expected) == library.decode(expected)


def test_white_space_runs(table, library):
    for n in range(70):
        for text in (" " * n, " " * n + "a", "a" + " " * n + "the" + "\n" * n, "▁" * n):
            same(table, library, text)


def test_random_texts(table, library):
    r = random.Random(1)
    parts = ["a", "e", "t", "th", "▁", " ", " ", "\n", "é", "日", "本", "𠀀", "\x00", ".", "<s>", "</s>", "ing", "\t", "ß", "22", "😀"]
    for _ in range(3_000):
        same(table, library, "".join(r.choice(parts) for _ in range(r.randint(0, 40))))
    same(table, library, "abcdefgh" * 2_000)


def test_texts_of_the_table(table, library, spark, root):
    for row in spark.read.parquet(f"{root}/documents.parquet").collect():
        same(table, library, row["text"])


def test_decoding_of_any_ids(table, library):
    r = random.Random(2)
    for _ in range(3_000):
        numbers = [r.choice([1, 2, 0, 3, 100, 200, 230, 259, 264, 28705, 13, 300, 1000, 31999]) for _ in range(r.randint(0, 8))]
        assert table.decode(numbers) == library.decode(numbers)


def test_awkward_rows(awkward, nothing, library):
    digests = encode_digests(awkward, vocabulary()).collect()
    whole = encode(awkward, vocabulary()).collect()
    texts = [r["text"] or "" for r in awkward.collect()]
    expected = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [list(r["ids"]) for r in whole] == expected and [r["decoded"] for r in whole] == texts
    for r, numbers, text in zip(digests, expected, texts, strict=True):
        assert r["n_tokens"] == len(numbers)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(numbers)}I", *numbers)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert encode_digests(nothing, vocabulary()).count() == 0
