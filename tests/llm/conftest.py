import pytest

CLASHES = "digest size shard slot group line rank row node bucket label component_id kept lang_pred score text_hash _key"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, ids used twice, clashing extra columns."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven."), (2, None), (3, ""), (4, "  \n\t "), (5, long),
        (6, "one two three four five six seven."), (6, "one two three four five six seven."),
        (7, "first text with the same id as another."), (7, "second text, quite different from the first."),
        (None, "a text without an id stands here."), (None, None), (8, "123 456"), (9, "é ß 日本 𠀀\x00!"),
    ]
    clashes = CLASHES.split()
    data = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(clashes)) for i, t in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame(data, columns + ", ".join(f"{c} string" for c in clashes))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")
