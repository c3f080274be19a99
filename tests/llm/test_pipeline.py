"""The pipeline's stages, one after the other, against what each must do."""

import corpus_pipeline
from redebit.llm import jaccard_join
from redebit.llm.common import stored, table
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    before = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == before.columns
        sizes.append(docs.count())
    assert 0 < sizes[0] < before.count() and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id", "start").distinct().count() > 0
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_near_copies_are_gone_after_the_join(spark):
    kept = stored(corpus_pipeline.drop_near_copies(spark, table(spark, SF, "documents"), SF))
    again = jaccard_join.join_documents(kept)
    assert again.where("n_links > 0").count() == 0


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (fixtures.documents(spark), fixtures.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
