import pytest

from lathe.queries import QUERIES, SQL
from tests.oracle import DIR, assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"model_boosting", "model_forest", "analysis_metrics"}))
def test_query_without_sql_gives_sound_rows(spark, name):
    got = QUERIES[name](spark, DIR)
    found = got.collect()
    assert found
    if "r2_train" in got.columns:
        assert all(r.r2_train > -0.5 and r.rmse >= 0 for r in found)


def test_entry_has_all_queries(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1


def test_rest_does_not_need_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).parent.parent / "lathe"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lathe.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
