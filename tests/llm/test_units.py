import random
import tracemalloc

import pyarrow as pa

from docmill.llm import passages
from docmill.llm.op4_units import repeated_text, repeated_units, units, without

PASSAGE = "Shared words go on here for long. And a second sentence of the passage follows it."


def test_units_tile_sentences_and_lines():
    text = "One two three. Four five\nsix seven!  Eight nine ten"
    found = units(text, 2)
    assert [text[s : s + n] for s, n, _ in found] == ["One two three.", "Four five", "six seven!", "Eight nine ten"]
    assert units("v1.2.3 is out", 1) == [(0, 13, "v1.2.3 is out")]


def test_earliest_occurrence_stays(spark):
    rows = [
        (5, f"Intro of five. {PASSAGE} End of five."), (3, f"Other start. {PASSAGE.upper()} tail here."),
        (9, f"{PASSAGE}\n{PASSAGE}"), (4, "Nothing in here repeats at all, not one unit of it."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in repeated_units(docs).collect()}
    first, second = PASSAGE.index("Shared"), PASSAGE.index("And")
    expected, texts = set(), dict(rows)
    for doc, base in ((5, 15), (9, 0), (9, len(PASSAGE) + 1)):
        for part, length in ((first, 33), (second, 48)):
            expected.add((doc, base + part, length, 3, 13 + part))
    assert found == expected
    for doc, start, length, kept, kept_start in found:
        a, b = texts[doc][start : start + length], texts[kept][kept_start : kept_start + length]
        assert a.lower() == b.lower()
    cut = {r["doc_id"]: r["text"] for r in without(docs, repeated_units(docs)).collect()}
    assert cut[5] == "Intro of five.   End of five." and cut[3] == texts[3] and cut[9].strip() == ""


def test_against_brute_force(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen, expected = {}, set()
    for row in sorted(docs.select("doc_id", "text").collect()):
        for start, length, unit in units(row["text"]):
            if unit in seen:
                expected.add((row["doc_id"], start, length, *seen[unit]))
            else:
                seen[unit] = (row["doc_id"], start)
    assert {tuple(r) for r in repeated_units(docs).collect()} == expected


def test_awkward_rows(awkward, nothing):
    found = repeated_units(awkward)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in found.collect()} == {(6, 1)}
    cut = without(awkward, found)
    assert cut.columns == awkward.columns and cut.count() == awkward.count()
    assert repeated_units(nothing).count() == 0


def _words(r, n):
    return " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n))


def test_passages_in_mid_sentence_are_covered_whole(spark):
    r = random.Random(3)
    long = f"{_words(r, 30)}. {_words(r, 25)}! {_words(r, 20)}"
    short = _words(r, 12)
    rows = [(i, f"{_words(r, 9 + i)} {p.upper() if i == 3 else p} {_words(r, 7)}. {_words(r, 8)}.")
            for i, p in ((1, long), (2, short), (3, long), (4, short.replace(" ", "\n ")), (5, f"{long} {short}"))]
    docs, texts = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    found = repeated_text(docs).collect()
    for x in found:
        a = texts[x["doc_id"]][x["start"] : x["start"] + x["length"]].lower().split()
        assert texts[x["kept_doc_id"]][x["kept_start"] :].lower().split()[: len(a)] == a
    cut = {x["doc_id"]: x["text"] for x in without(docs, repeated_text(docs)).collect()}
    assert cut[1] == texts[1] and cut[2] == texts[2]
    for i, p in ((3, long), (4, short), (5, f"{long} {short}")):
        left = texts[i].lower().split()
        at = left.index(p.split()[0])
        assert cut[i].lower().split() == left[:at] + left[at + len(p.split()) :]


def test_runs_against_brute_force(spark):
    r = random.Random(8)
    some = [" ".join(f"v{r.randint(0, 2)}" for _ in range(r.randint(3, 9))) for _ in range(5)]
    rows = [(i // 2 or None, r.choice([" ", "\n", "  "]).join(r.choice(some) for _ in range(r.randint(0, 6))))
            for i in range(0, 40, 2)]
    seen, expected = {}, set()
    for doc, text in sorted(rows, key=lambda x: x[0] or 0):
        words = text.split()
        for i in range(len(words) - 4):
            run = tuple(words[i : i + 5])
            first = seen.setdefault(run, (doc, i))
            if first[0] != doc or i - first[1] >= 5:
                expected |= {(doc, i + k) for k in range(5)}
    docs, texts, got = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows), set()
    for x in repeated_text(docs, min_words=100, min_run=5).collect():
        at = len(texts[x["doc_id"]][: x["start"]].split())
        got |= {(x["doc_id"], at + k) for k in range(len(texts[x["doc_id"]][x["start"] :][: x["length"]].split()))}
    assert got == expected and expected


def test_runs_of_awkward_rows(awkward, nothing):
    assert {(r["doc_id"], r["kept_doc_id"]) for r in repeated_text(awkward, min_run=3).collect()} == {(6, 1)}
    assert repeated_text(nothing).count() == 0


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, f"{PASSAGE} One."), (2, f"Two. {PASSAGE}")], "doc_id long, text string")
    found = repeated_units(docs)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert found.count() == 2


def test_units_after_other_white_space_and_dots():
    text = "One two...  Three\u00a0four!\t Five?six\r\n.\n\n. Seven"
    assert [text[s : s + n] for s, n, _ in units(text, 1)] == [
        "One two...", "Three\u00a0four!", "Five?six\r", ".", ".", "Seven",
    ]


def test_words_of_large_batches_take_little_memory():
    r = random.Random(5)
    texts = [_words(r, 600) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts)], ["key", "text"])
    tracemalloc.start()
    rows = 0
    for part, words, _ in passages._batches(iter([batch]), True):
        words.groups(9, passages._BASES[0])
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 600 and peak < 50 << 20
