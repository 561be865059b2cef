import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import chunking as C
from docmill.operators import embedding as E


def walk(text, size, overlap, least):
    """Windows found one by one, for comparison."""
    start, out = 0, []
    while start < len(text):
        end = start + size
        if end < len(text):
            zone = [i for i in range(max(start + least, end - 200) + 1, end + 1) if text[i] in ".!?\n"]
            end = zone[-1] + 1 if zone else end
        piece = text[start:end].strip()
        if piece:
            out.append((len(out), piece, start, end))
        start = end - overlap
    return out


def chunked(spark, texts, **params):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = C.chunk_sliding(frame, **params).orderBy("doc_id", "chunk_index").collect()
    found = {i: [] for i in range(len(texts))}
    for r in rows:
        found[r["doc_id"]].append((r["chunk_index"], r["content"], r["start_char"], r["end_char"]))
        assert r["token_count"] == len(r["content"]) // 4
    for r in rows:
        assert r["total_chunks"] == len(found[r["doc_id"]])
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    "text,spans",
    [
        ("a" * 2300, [(0, 1000), (800, 1800), (1600, 2600)]),
        ("a" * 900, [(0, 1000), (800, 1800)]),
        ("a" * 950 + "." + "b" * 500, [(0, 951), (751, 1751)]),
        ("a" * 800 + "." + "b" * 500, [(0, 1000), (800, 1800)]),
        ("a" * 801 + "." + "b" * 500, [(0, 802), (602, 1602)]),
        ("a" * 1000 + "." + "b" * 500, [(0, 1001), (801, 1801)]),
        ("", []),
        (" \n\t ", []),
    ],
)
def test_spans(spark, text, spans):
    assert [(s, e) for _, _, s, e in chunked(spark, [text])[0]] == spans


@pytest.mark.parametrize(
    "size,overlap,least", [(1000, 200, 100), (300, 50, 20), (150, 0, 100), (250, 100, 240), (120, 21, 30), (400, 150, 399)]
)
def test_against_plain_walk(spark, size, overlap, least):
    rng = random.Random(size)
    alphabet = "abcde .!?\né\U0001f600　"
    texts = ["".join(rng.choices(alphabet, weights=[20] * 5 + [10, 1, 1, 1, 1, 5, 2, 1], k=rng.randrange(0, 4000)))
             for _ in range(40)]
    texts += ["x" * (size + d) for d in (-1, 0, 1)] + [" " * 3000 + "end."]
    got = chunked(spark, texts, size=size, overlap=overlap, min_size=least)
    assert got == [walk(t, size, overlap, least) for t in texts]


def test_limits():
    with pytest.raises(ValueError):
        C.ChunkingConfig(chunk_overlap=1000)
    with pytest.raises(ValueError):
        C.ChunkingConfig(min_chunk_size=0)
    with pytest.raises(ValueError):
        C.ChunkingConfig(chunk_size=50, chunk_overlap=10)
    with pytest.raises(ValueError):
        C.ChunkingConfig(max_tokens=100)
    with pytest.raises(ValueError):
        C.check_window(200, 199, 100)
    assert C.ChunkingConfig().chunk_size == 1000


def test_structured(spark):
    text = (
        "intro line\n\n# One\nalpha beta\n\ngamma\n\n## Deep\ndelta\n# Two\n" + "word " * 1200 + "\n\ntail"
    )
    frame = spark.createDataFrame([(1, text), (2, "   "), (3, "only")], "doc_id int, text string")
    rows = C.chunk_structured(frame, max_tokens=512).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert [r["heading_path"] for r in first[:3]] == ["", "One", "One\nDeep"]
    assert first[1]["content"] == "One\nalpha beta\ngamma"
    assert all(len(r["content"]) <= 512 * 4 + len(r["heading_path"]) + 1 for r in rows)
    # nothing is lost: all words but the heading marks come back in order
    bodies = [r["content"][len(r["heading_path"]):].split() for r in first]
    plain = [w for line in text.split("\n") if not line.startswith("#") for w in line.split()]
    assert [w for b in bodies for w in b] == plain
    assert [r["content"] for r in rows if r["doc_id"] == 3] == ["only"]
    assert not [r for r in rows if r["doc_id"] == 2]
    assert all(r["total_chunks"] == len(first) for r in first)


def test_pages(spark):
    rows = [
        (1, None, 3), (1, None, 5), (1, None, 4), (2, None, 2), (2, None, None), (2, None, 4),
        (3, 10, 5), (4, None, None),
    ]
    frame = spark.createDataFrame(rows, "chunk int, meta_page int, page_no int")
    got = {r["chunk"]: (r["page_start"], r["page_end"]) for r in C.with_page_range(frame, ["chunk"]).collect()}
    assert got == {1: (3, 5), 2: (2, 4), 3: (10, 10), 4: (None, None)}


def test_embedding_errors_and_blanks(spark):
    class Failing(E.HashedWords):
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("model down")
            return super().__call__(texts)

    frame = spark.createDataFrame([(1, "good words"), (2, "bad"), (3, "  "), (4, "x" * 40000)], "id int, content string")
    rows = {r["id"]: r for r in E.embed(frame.coalesce(1), embedder=Failing(8), batch_size=3, delay=0.0).collect()}
    assert sum(x * x for x in rows[1]["embedding"]) == pytest.approx(1)
    assert rows[2]["embedding"] == [0.0] * 8 and rows[2]["embedding_error"] == "model down"
    assert rows[3]["embedding"] == [0.0] * 8 and rows[3]["embedding_error"] is None
    cut = frame.select(F.length(E.embedding_text(F.col("content")))).collect()
    assert [r[0] for r in cut] == [10, 3, 0, 32764]


def test_busy_model_is_asked_again():
    calls = []

    def busy(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise E.RateLimited("slow down")
        return [[1.0, 2.0]] * len(texts)

    vectors, errors = E.embed_batch(busy, ["a", "b"], 2, delay=0.0)
    assert calls == [2, 2, 2] and errors == [None, None] and [list(v) for v in vectors] == [[1.0, 2.0]] * 2

    def always(texts):
        raise E.RateLimited("closed")

    vectors, errors = E.embed_batch(always, ["a"], 2, delay=0.0)
    assert errors == ["closed"] and list(vectors[0]) == [0.0, 0.0]


def test_tokenizer(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "")], "id int, content string")
    got = {r["id"]: r["token_count"] for r in C.with_token_count(frame, str.split).collect()}
    assert got == {1: 3, 2: 0}
    assert [r["token_count"] for r in C.with_token_count(frame).orderBy("id").collect()] == [1, 0]


def test_counted_chunks_fit_the_tokenizer(spark):
    """No chunk is above the limit by the tokenizer's own count, and no word is lost."""
    import re

    rng = random.Random(6)
    tokenizer = lambda text: re.findall(r"\n| ?[a-z]{1,3}|[^a-z]", text)
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            if rng.random() < 0.3:
                parts.append("#" * rng.randrange(1, 4) + " head" + "x" * rng.randrange(0, 30))
            parts.append(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([1, 3, 20, 80]))))
        texts.append("\n\n".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = C.chunk_tokens(frame, C.tokenizer_counter(tokenizer), 40, line_tokens=1).orderBy("doc_id", "chunk_index").collect()
    assert max(len(tokenizer(r["content"])) for r in rows) <= 40
    said = {i: [] for i in range(len(texts))}
    for r in rows:
        body = r["content"][len(r["heading_path"]) :] if r["heading_path"] else r["content"]
        said[r["doc_id"]] += body.split()
    assert said == {i: [w for b in t.split("\n\n") if not b.startswith("#") for w in b.split()] for i, t in enumerate(texts)}
    joined = [r for r in rows if "\n" in r["content"]]
    assert joined


def test_long_text_is_packed_in_linear_time(spark):
    import time

    frame = spark.createDataFrame([(1, "word " * 200_000)], "doc_id int, text string")
    begun = time.time()
    sizes = [r["body_tokens"] for r in C.chunk_tokens(frame, C.word_counter, 512).select("body_tokens").collect()]
    assert sum(sizes) == 200_000 and max(sizes) == 512 and time.time() - begun < 30
