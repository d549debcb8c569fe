import pytest
from compare import same
from conftest import SF

from presslight.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry_works_without_the_llm_folders(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, key", [("b_cand", "p_partkey"), ("b_loan", "c_custkey"), ("b_clip", "c_custkey")])
def test_tables_that_grow_are_not_sent_whole(spark, name, key):
    from presslight.plans.bindings import bind

    plan = bind(spark, SF, name)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line and key in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)


def test_pullthrough_reads_what_is_said_once(spark):
    plan = registry.QUERIES["AG-18b"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
