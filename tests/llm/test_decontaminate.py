import random
import re

from docmill.llm import op8_decontaminate
from docmill.llm.op8_decontaminate import _codes, _grams, _offsets, _searches, contaminated, normalised


def distance(item, text):
    """Least edits between the item and any stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_grams_are_the_bytes_of_each_window():
    for n in range(14):
        codes = _codes("abcdefghijklmnopq"[:n])
        for q in (5, 8):
            windows = [bytes(codes[i : i + q].astype("u1")) for i in range(max(0, n - q + 1))]
            assert _grams(codes, q).tolist() == [int.from_bytes(w, "big") for w in windows]


def test_edited_items_against_full_alignment():
    r = random.Random(3)
    parts = ["the", "onin", "er", "thand", "éle", "reat", "sh", "ing", "of", "ation"]

    def phrase(n):
        return normalised(" ".join(r.choice(parts) + r.choice(parts) for _ in range(n)))

    for _ in range(60):
        items = [(i, t) for i in range(4) if len(t := phrase(r.randint(4, 20))) >= 25]
        letters = list(r.choice(items)[1])
        for _ in range(r.randint(0, int(len(letters) * 0.14))):
            at = r.randrange(len(letters))
            letters[at : at + r.randint(0, 1)] = r.choice(["", "x", "ab"])
        text = normalised(f"{phrase(25)} {''.join(letters)} {phrase(25)}")
        found = {s.ids[m[0]]: m for s in _searches(items, 0.1) for m in s.search(text, _codes(text))}
        for i, item in items:
            least = distance(item, text)
            assert (i in found) == (least <= int(len(item) * 0.1))
            if i in found:
                _, start, end, edits = found[i]
                assert edits == least and distance(item, text[start:end]) == least


def test_repetitive_texts():
    item = normalised("con de la " * 12)
    text = normalised("con de la " * 400)
    searches = _searches([(1, item)], 0.1)
    found = [m for s in searches for m in s.search(text, _codes(text))]
    assert found and all(edits == 0 and text[a:b] == item for _, a, b, edits in found)


def test_short_items_match_whole_words_exactly():
    r = random.Random(5)
    words = ["a", "the", "ab", "café", "seven", "42", "x-ray", "no", "quickly"]
    for _ in range(200):
        items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for i in range(5)]
        items = [(i, t) for i, t in items if len(t) < 25]
        text = "".join(r.choice(words) + r.choice([" ", " ", "", ", "]) for _ in range(30)).strip()
        found = {s.ids[m[0]]: m for s in _searches(items, 0.1) for m in s.search(text, _codes(text))}
        expected = {
            i for i, t in items
            if re.search(("(?<![^\\W_])" if t[0].isalnum() else "") + re.escape(t) + ("(?![^\\W_])" if t[-1].isalnum() else ""), text)
        }
        assert set(found) == expected
        assert all(edits == 0 and text[a:b] == dict(items)[i] for i, (_, a, b, edits) in found.items())


def test_long_repetitive_texts_in_stretches(monkeypatch):
    """Many shared q-grams: bounded slices give what one count of all gives."""
    r = random.Random(6)
    items = [(0, normalised("on and on " * 60)), (1, normalised("and so on and on it goes " * 4)), (2, "on and on and on again and again")]
    parts = ["on and ", "on it goes ", "again ", "and so "]
    text = normalised("".join(r.choice(parts) for _ in range(300)) + "on and on " * 70 + "".join(r.choice(parts) for _ in range(300)))
    whole = [(s.ids[m[0]], *m[1:]) for s in _searches(items, 0.1) for m in s.search(text, _codes(text))]
    monkeypatch.setattr(op8_decontaminate, "PAIRS", 1_000)
    sliced = [(s.ids[m[0]], *m[1:]) for s in _searches(items, 0.1) for m in s.search(text, _codes(text))]
    assert whole == sliced and {0} <= {m[0] for m in whole}
    monkeypatch.setattr(op8_decontaminate, "STRETCH", 256)
    parted = [(s.ids[m[0]], *m[1:]) for s in _searches(items, 0.1) for m in s.search(text, _codes(text))]
    assert {m[0] for m in parted} == {m[0] for m in whole}
    assert {i for i, t in items if distance(t, text) <= int(len(t) * 0.1)} == {m[0] for m in whole}
    long = normalised("con de la " * 100_000)
    assert [m for s in _searches([(1, normalised("con de la " * 6))], 0.1) for m in s.search(long, _codes(long))]


def test_offsets_of_the_original():
    text = "  Ab\n C  d\t"
    places, length = _offsets(text)
    assert normalised(text) == "ab c d" and [text[i] for i in places] == ["A", "b", "\n", "C", " ", "d"]
    assert length == len(text)


def test_all_verbatim_items_of_the_tables(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    benchmark = spark.read.parquet(f"{root}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = {r["item_id"]: normalised(r["text"]) for r in benchmark.collect()}
    expected = {(i, j) for i, t in texts.items() for j, item in items.items() if item in normalised(t)}
    found = contaminated(docs, benchmark, block_chars=2_000).collect()
    assert expected and expected <= {(r["doc_id"], r["item_id"]) for r in found}
    for r in found:
        region = normalised(texts[r["doc_id"]][r["start"] : r["end"]])
        assert distance(items[r["item_id"]], region) == r["edits"]


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame(
        [(1, "One two three  four five six seven."), (2, None), (3, ""), (4, "short"),
         (None, "one two three four five six seven."), (5, "nowhere to be found in any of the texts")],
        "item_id long, text string",
    )
    found = contaminated(awkward, items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["start"], r["end"], r["edits"]) for r in found) == sorted(
        [(1, 1, 0, 34, 0), (1, 0, 0, 34, 0)] + [(6, 1, 0, 34, 0), (6, 0, 0, 34, 0)] * 2
    )
    assert contaminated(nothing, items).count() == 0 and contaminated(awkward, items.where("1 = 0")).count() == 0
