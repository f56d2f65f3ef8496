import pytest
from comparing import SMALL, assert_same

from framequarry.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, llm.queries()[name], llm.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline
    from framequarry.llm import near_dedup, quality, toxicity
    from framequarry.runtime import table

    docs = table(spark, SMALL, "documents")
    assert corpus_pipeline.ORACLE_SQL is None
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SMALL)
        assert out.columns == docs.columns
        before, after = {r["doc_id"]: r["text"] for r in held.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SMALL, "labels"))
            gone = {r["doc_id"] for r in toxicity.score(held, model).collect() if r["score"] >= 0.5}
        elif name == "quality":
            gone = {r["doc_id"] for r in quality.judge(held).collect() if not r["kept"]}
        elif name == "near_dedup":
            gone = {r["doc_id"] for r in near_dedup.near_duplicates(held).collect() if not r["kept"]}
        else:
            gone = set()
        assert set(before) - set(after) == gone
        if name != "pii":
            assert all(after[d] == before[d] for d in after)
        held = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in held.collect()}
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(tuple(r) for r in packed)


def test_pipeline_on_awkward_rows(spark):
    import corpus_pipeline
    from tables import TEXTS, awkward, empty

    for make in (awkward, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= 40 * len(TEXTS)
            docs = spark.createDataFrame(out.collect(), out.schema) if out.columns == docs.columns else docs
