"""Every query and stage on nulls, empties, ties, repeats, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from marlstone.llm import queries
from marlstone.llm.common import rank_by_class

#: The one query that reads no documents has tests of its own.
OF_DOCUMENTS = sorted(set(queries.QUERIES) - {"op13_hard_negatives"})


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_odd_rows(spark, odd, as_tables, name):
    got = queries.QUERIES[name](spark, as_tables(odd))
    rows = got.collect()
    assert len(rows) == odd.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert len(set(got.columns)) == len(got.columns)


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_table(spark, none, as_tables, name):
    assert queries.QUERIES[name](spark, as_tables(none)).collect() == []


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_reruns_agree(spark, odd, as_tables, name):
    folder = as_tables(odd)
    rows = lambda: sorted(map(str, queries.QUERIES[name](spark, folder).collect()))
    assert rows() == rows()


def test_stages_on_odd_rows(spark, odd, none):
    for source in (odd, none):
        docs = source
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), out.schema)


def test_rank_in_runs_is_gapless(spark):
    df = spark.range(2000).selectExpr("id", "id % 3 as part", "case when id < 1500 then 0 else id end as size")
    ranked = rank_by_class(df, ["part"], ["size"], "id", run_rows=50).collect()
    for p in range(3):
        own = sorted((r["rank"], r["size"]) for r in ranked if r["part"] == p)
        assert [k for k, _ in own] == list(range(len(own)))
        assert [s for _, s in own] == sorted(s for _, s in own)
