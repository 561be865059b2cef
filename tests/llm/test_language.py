import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm.op6_language import END, START, _estimate, identify, train, words_of
from docmill.llm.queries import language_query


def plain(words, order):
    """Kneser-Ney by its definition, on dictionaries: log probability of a word."""
    counts = [None] + [Counter() for _ in range(order)]
    for word, n in words.items():
        text = START + word + END
        for i in range(1, len(text)):
            gram = text[max(0, i + 1 - order) : i + 1]
            counts[len(gram)][gram] += n
    raw = [None] + [Counter({g: n for g, n in c.items() if g[0] == START}) for c in counts[1:]]
    levels = {order: counts[order]}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
        levels[k].update(raw[k])
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, level in levels.items():
        one, two = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        discount[k] = min(max(one / max(one + 2 * two, 1) if one else 0.5, 0.1), 0.9)
        for g, n in level.items():
            total[k, g[:-1]] += n
            kinds[k, g[:-1]] += 1
    uniform = 1 / max(len(levels[1]) + 1, 2)

    def p(gram):
        k = len(gram)
        if k == 0:
            return uniform
        context = gram[:-1]
        if not total[k, context]:
            return p(gram[1:])
        return (max(levels[k][gram] - discount[k], 0) + discount[k] * kinds[k, context] * p(gram[1:])) / total[k, context]

    def word(w):
        text = START + w + END
        return sum(math.log(p(text[max(0, i + 1 - order) : i + 1])) for i in range(1, len(text)))

    return word, levels


@pytest.mark.parametrize("order", [2, 3, 4])
def test_estimates_match_the_definition(order):
    words = {"banana": 3, "ban": 1, "nab": 2, "abba": 1, "a": 5}
    word, levels = plain(words, order)
    rows = [("xx", g, n) for level in levels.values() for g, n in level.items()]
    model = _estimate(rows, order)
    for w in ["banana", "ban", "bab", "a", "nnn", "zoo", "bz"]:
        assert abs(model.score([w])[0, 0] - word(w)) < 1e-9, w
    joint = model.score(["banana", "zoo", "a"])[:, 0]
    assert joint.tolist() == [model.score([w])[0, 0] for w in ("banana", "zoo", "a")]


def test_counts_by_spark_match(spark):
    """Equal texts, so that it does not matter which rows calibrate."""
    docs = spark.createDataFrame([(i, "banana ban abba", "aa") for i in range(50)], "doc_id long, text string, lang string")
    model = train(docs, order=3)
    found = [model.score([w])[0, 0] for w in ("banana", "bab", "zoo")]
    expected = []  # for any number of rows that calibrate
    for n in range(25, 51):
        word, _ = plain({"banana": n, "ban": n, "abba": n}, 3)
        expected.append(max(abs(a - word(w)) for a, w in zip(found, ("banana", "bab", "zoo"), strict=True)))
    assert min(expected) < 1e-9
    assert model.languages == ["aa"] and (model.limits > 0).all()


def test_words():
    assert words_of("Ab1c² d_e É") == ["ab", "c", "d", "e", "é"]
    assert [len(w) for w in words_of("x" * 2_500)] == [1_000, 1_000, 500]


def test_held_out_accuracy(spark, root):
    found = language_query(spark, root).toPandas()
    truth = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    held = both[both["held_out"]]
    assert len(found) == len(truth) and (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert both["score"].between(0, 1).all() and both["rejected"].mean() < 0.01


def test_rejection(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = train(docs)
    odd = spark.createDataFrame(
        [(1, "съешь ещё этих мягких французских булок да выпей чаю и ещё немного"), (2, docs.first()["text"])],
        "doc_id long, text string",
    )
    found = {r["doc_id"]: r for r in identify(odd, model).collect()}
    assert found[1]["rejected"] and not found[2]["rejected"]


def test_mislabelled_rows_do_not_open_the_filter(spark, root):
    """Every 25th row of a language is junk; such texts are rejected all the same, the language's are not."""
    docs = spark.read.parquet(f"{root}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")

    def junk(seed):
        return F.translate(F.concat_ws(" ", *(F.sha2(F.concat(seed.cast("string"), F.lit(str(i))), 256) for i in range(6))), "0123456789", "qxzjkvwpyg")

    mixed = docs.withColumn("text", F.when(F.col("doc_id") % 25 == 0, junk(F.col("doc_id"))).otherwise(F.col("text")))
    odd = spark.range(-20, 0).select(F.col("id").alias("doc_id"), junk(F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rejected = {r["doc_id"] for r in identify(docs.unionByName(odd), train(mixed)).where("rejected").collect()}
    assert set(range(-20, 0)) <= rejected and len(rejected) - 20 < 0.01 * docs.count()


def test_rare_languages_and_bounds(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-i, "zażółć gęślą jaźń w Szczebrzeszynie chrząszcz brzmi", "pl") for i in range(1, 4)], docs.schema)
    model = train(docs.unionByName(rare), sample_rows=60, sample_chars=20_000)
    at = model.languages.index("pl")
    assert model.languages == ["en", "pl"] and np.isinf(model.limits[at]) and np.isfinite(model.limits[1 - at])
    found = identify(rare, model).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in found} == {("pl", False)}
    whole = train(docs.unionByName(docs).unionByName(docs), sample_rows=60)  # repeated rows count once
    once = train(docs, sample_rows=60)
    assert [h.tolist() for h in whole.hashes] == [h.tolist() for h in once.hashes]


def test_awkward_rows(awkward, nothing):
    model = train(awkward)
    found = identify(awkward, model, passed=["doc_id", "text"]).collect()
    assert len(found) == awkward.count()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["rejected"] >= (not letters)
    assert identify(nothing, model, passed=["doc_id"]).count() == 0
    empty = train(nothing)
    assert {r["lang_pred"] for r in identify(awkward, empty, passed=["doc_id"]).collect()} == {"und"}
