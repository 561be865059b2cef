import random

from docmill.llm.op2_lines import deleted_runs, repeated_lines, repeated_runs, shortest_runs, without_lines


def brute(docs, least):
    """(doc, line) of all lines in a run of ``least`` words that occurs at an earlier place."""
    texts = [[x.strip() for x in t.split("\n") if x.strip()] for _, t in sorted(docs)]
    ids = [i for i, _ in sorted(docs)]
    places = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]
    gone = set()
    for at, (d, i) in enumerate(places):
        best = 0
        for e, j in places[:at]:
            n = 0
            while i + n < len(texts[d]) and j + n < len(texts[e]) and texts[d][i + n] == texts[e][j + n]:
                n += 1
            if sum(len(x.split()) for x in texts[d][i : i + n]) >= least:
                best = max(best, n)
        gone |= {(ids[d], i + k) for k in range(best)}
    return gone


def test_shortest_runs():
    ahead, behind = shortest_runs([3, 1, 5, 2], 5)
    assert ahead.tolist() == [3, 2, 1, 0]
    assert behind.tolist() == [0, 0, 1, 2]


def test_against_brute_force(spark):
    r = random.Random(5)
    for _ in range(2):
        lines = [" ".join(f"w{r.randint(0, 3)}" for _ in range(r.randint(1, 4))) for _ in range(4)]
        docs = [
            (i, "\n".join(r.choice([*lines, "", " "]) if r.random() < 0.95 else f"u{r.random()}"
                          for _ in range(r.randint(0, 12))))
            for i in range(14)
        ]
        docs.append((14, docs[3][1]))
        table = spark.createDataFrame([*docs, docs[2]], "doc_id long, text string")
        found = {(x["doc_id"], x["line"]) for x in repeated_lines(table, min_words=8).collect()}
        assert found == brute(docs, 8)


def test_spans_and_cut_texts(spark):
    run = "alpha beta gamma\ndelta epsilon zeta eta"
    docs = spark.createDataFrame(
        [(1, f"start\n{run}\nend", "x"), (2, f"other\n\n{run}\nrest", "y"), (3, run, "z")],
        "doc_id long, text string, _cut string",
    )
    repeated = repeated_lines(docs, min_words=7)
    spans = {r["doc_id"]: r for r in deleted_runs(repeated).collect()}
    assert set(spans) == {2, 3}
    assert (spans[2]["start"], spans[2]["length"], spans[2]["first_line"], spans[2]["n_lines"]) == (7, len(run), 1, 2)
    assert (spans[2]["kept_doc_id"], spans[2]["kept_line"]) == (1, 1)
    kept = without_lines(docs.drop("_cut"), repeated).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(1, f"start\n{run}\nend"), (2, "other\n\nrest")}


def test_awkward_rows(awkward, nothing):
    found = repeated_lines(awkward, min_words=5)
    assert {(r["doc_id"], r["line"]) for r in found.collect()} == {(6, 0)}
    kept = without_lines(awkward, found)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2
    assert repeated_lines(nothing).count() == 0 and without_lines(nothing, repeated_lines(nothing)).count() == 0


def test_passages_inside_lines(spark):
    r = random.Random(4)
    some = [" ".join(f"w{r.randint(0, 10**9)}" for _ in range(n)) for n in (50, 70)]
    rows = [
        (1, f"first line\nbefore {some[0]} after"), (2, f"{some[1]}\nmore"), (3, f"a\n\nb c {some[0]} d\ne"),
        (4, f"x\n{some[1]}\ny"), (5, f"z {some[1].replace(' ', chr(10), 1)} z"), (6, some[0].upper()),
        (7, "b " + some[0].split(" ", 1)[1]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(x) for x in repeated_runs(docs).collect())
    assert found == [
        (3, 1, 1, 7, len(some[0]), 1, 1), (4, 1, 1, 2, len(some[1]), 2, 0), (5, 0, 2, 2, len(some[1]), 2, 0),
    ]


def test_tables_of_lines_are_freed(spark):
    from pathlib import Path

    from docmill.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    run = "\n".join(f"line {i} of some words" for i in range(20))
    docs = spark.createDataFrame([(i, f"{run}\nend {i}") for i in range(4)], "doc_id long, text string")
    before = set(folder.glob("stored-*"))
    found = repeated_runs(docs)
    assert len(set(folder.glob("stored-*")) - before) == 2  # runs of lines, passages
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3}


def test_bitmaps_are_sent_packed(spark):
    from docmill.llm.passages import SLOTS, _bitmap, _bits

    packed = _bitmap(spark.createDataFrame([(5,), (SLOTS - 1,), (SLOTS + 9,), (-1,)], "h long"))
    bits = _bits(packed)
    assert len(packed) < 1 << 20 and len(bits) == SLOTS // 8
    assert {int(i) for i in bits.nonzero()[0]} == {0, 1, SLOTS // 8 - 1}
