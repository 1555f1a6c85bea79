import os

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def test_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p6_found", "text_vector_search"} <= set(sql)
    assert not any(word in text.lower() for text in sql.values() for word in ("tablesample", "using sample"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "p6_found", "gallery_modified", "ocr_simple_bm25", "rrf_sources", "image_search_best_frame"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    df = contract.queries()[name](spark, FOLDER)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(columns) and got == want
