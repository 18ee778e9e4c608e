"""Every checked query against its SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as contract
from checks.compare import differences, oracle
from checks.registry import CHECKS


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_agrees_with_sql(spark, connection, sf_dir, name):
    assert differences(spark, connection, name, sf_dir) == []


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize(
    "name",
    [
        "device_event_map",
        "object_at_events",
        "event_matches_by_time_60",
        "event_closest_mapped",
        "event_closest_by_time",
        "event_mean_by_time_30",
        "event_median_mapped_1440",
        "log_overview",
        "directly_follows",
    ],
)
def test_no_plan_multiplies_tables(spark, sf_dir, name):
    plan = CHECKS[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_scans_read_what_they_need(spark, sf_dir):
    plan = CHECKS["device_type_stats"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan and "PushedFilters: [In(event_type" in plan
