"""Registered queries against their SQL, and the pipeline's rows."""

import corpus_pipeline
import pytest

from lumentrace.llm import common, queries

from tests.conftest import DATA


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_matches_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline_stages_keep_the_columns(spark):
    docs = common.table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = common.cut_lineage(docs)
        if name != "mix_sources":
            assert 0 < docs.count() <= n
            n = docs.count()
    packed = corpus_pipeline.pack_sequences(spark, docs, DATA)
    assert packed.where("offset + length > 2048").count() == 0
