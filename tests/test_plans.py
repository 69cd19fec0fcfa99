"""Plans: filters and columns reach the scan, and range joins make no product."""

import pytest

from tessera.plans import composites
from tessera.plans import queries as Q

assert composites


def plan(spark, small, name):
    return Q.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    p = plan(spark, small, "A02_point_lookup")
    assert "EqualTo(c_custkey,42)" in p and "c_mktsegment" not in p
    p = plan(spark, small, "B12_date_range")
    assert "GreaterThanOrEqual(o_orderdate" in p or "o_orderdate" in p.split("ReadSchema")[1]
    assert "props" not in plan(spark, small, "D05_by_hour")
    assert "o_orderpriority" not in plan(spark, small, "C07_left_default")


@pytest.mark.parametrize("name", ["C12_zone_incidents", "C13_services_per_zone", "C15_nearest_zone", "C18_blocking_pairs", "C19_two_hop", "C20_colocation", "H12_name_similarity", "L07_nearby_services", "M07_repeated_encounters", "N05_hidden_links"])
def test_no_product(spark, small, name):
    p = plan(spark, small, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["D21_dashboard", "L01_heatmap", "M05_findings", "N05_hidden_links", "I15_adamic_adar", "J01_extraction", "K13_resolution_queue"])
def test_columns_only(spark, small, name):
    p = plan(spark, small, name)
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
