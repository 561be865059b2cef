import corpus_pipeline
from docmill.llm.op8_decontaminate import normalised


def test_each_stage_on_its_own_input(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    items = [normalised(r["text"]) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, root))
        assert docs.columns == columns and docs.dtypes == spark.read.parquet(f"{root}/documents.parquet").dtypes
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        seen[name] = (before, after)
        if name != "lines":
            assert all(before[i] == t for i, t in after.items())
    before, after = seen["language"]
    assert len(after) > 0.98 * len(before)
    before, after = seen["lines"]
    for i, text in after.items():
        kept = iter(before[i].split("\n"))
        assert all(line in kept for line in text.split("\n"))
    before, after = seen["decontamination"]
    assert set(before) - set(after) == {i for i, t in before.items() if any(x in normalised(t) for x in items)}
    before, after = seen["near_duplicates"]
    assert len(set(after.values())) == len(after)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, root)
    assert tokens.count() == docs.count()


def test_awkward_rows(spark, awkward, nothing, root):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "language":  # its model knows no language from these few rows
            docs = corpus_pipeline.stored(stage(spark, docs, root))
            assert docs.columns == awkward.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert [k for k in kept if k[0] == 6] == [] and len([k for k in kept if k[0] == 7]) == 2
    assert len([k for k in kept if k[0] in (2, 3, 4)]) == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, root).count() == 0


def test_rows_that_repeat_are_near_duplicates(spark, root):
    rows = [(1, "one two three four five six", 27), (1, "one two three four five six", 27), (2, "other words", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, root).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]
