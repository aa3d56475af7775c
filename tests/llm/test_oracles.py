import pytest

from lathe.llm.queries import oracle_sql, queries
from tests.oracle import DIR, assert_same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    assert_same(spark, queries()[name], oracle_sql()[name])


def test_one_query_for_each_operator():
    assert [k.split("_")[0] for k in queries()] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(k for k in queries() if k.split("_")[0] not in ("op4", "op11", "op13")))
def test_queries_return_all_documents(spark, name):
    got = queries()[name](spark, DIR)
    n = spark.read.parquet(f"{DIR}/{'conversations' if name.startswith('op9_') else 'documents'}.parquet").count()
    assert got.count() >= n
