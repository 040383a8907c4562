"""Stages of the pipeline over empty tables, nulls, repeated rows and clashing columns."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, kept boolean, component_id long"


@pytest.fixture(scope="module")
def odd(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs += [(900, None, None), (901, "", None), (901, "", None), (None, "no id is here at all", None), (902, "1 2 3 !", None), (903, "word " * 30_000, "en"), docs[3], docs[3]]
    return spark.createDataFrame([(*d, "s", 1, 0.5, 7, True, 3) for d in docs], COLUMNS)


@pytest.mark.parametrize(("name", "work"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, odd, name, work):
    got = work(spark, odd, SF)
    if name == corpus_pipeline.STAGES[-1][0]:
        assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
        assert got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    else:
        assert got.columns == odd.columns and got.exceptAll(odd).count() == 0
        ids = {r.doc_id for r in got.collect()}
        assert {900, 901, 902} & ids == (set() if name == "language_id" else {900, 901, 902})
        assert len(ids) > 30
    assert work(spark, odd.limit(0), SF).count() == 0
