import duckdb
import pandas as pd
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Stages within hybrid_retrieval, whose result rests on each of them.
WITHIN = {"rank_fusion", "family_scores", "completeness_scores", "query_alignment", "family_selection", "rerank_context", "reranked_hits"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cell = lambda x: "null" if x is None or x is pd.NA or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - WITHIN))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    found = rows(queries.QUERIES[name](spark, SF).toPandas())
    spark.catalog.clearCache()
    assert found == rows(sql.sql(queries.ORACLE_SQL[name]).df())


def test_only_sequential_folds_have_no_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"consolidated_nodes", "section_windows"}
