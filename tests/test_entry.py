import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["clean_text_short", "kwic_words", "shingle_windows", "word_centroids", "inverse_rank_weights", "knn_graph",
         "vec_roundtrip", "stream_postings", "predict_center_nb"]


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) < set(queries) and len(queries) > 55


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file[:-8]} as select * from '{SF}/{file}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted(map(tuple, df[columns].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_flagship(spark):
    out = entry.entry(spark)
    assert isinstance(out.toPandas(), pd.DataFrame) and out.columns == ["word", "doc_id", "line_no", "offset", "window"]


def test_sql_needs_no_jar_folder(spark, monkeypatch):
    import pyspark

    import oracle_queries
    oracle_queries.stops.cache_clear()
    monkeypatch.setattr(pyspark, "__path__", ["/nowhere"])
    assert len(oracle_queries.oracle()) >= 49


def test_one_bad_text_leaves_the_others(spark, monkeypatch):
    import oracle_queries

    def broken(*_, **__):
        raise ValueError("no list")
    monkeypatch.setattr(oracle_queries, "stops", broken)
    assert "corpus_lines" in (sql := oracle_queries.oracle()) and "tfidf_windows" not in sql
