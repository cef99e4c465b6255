"""Plan shapes that must hold at any size."""

import re

import pytest

import __spark_entry__ as entry


def plan(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(text, table):
    line = next(x for x in text.splitlines() if "FileScan" in x and f"/{table}.parquet" in x)
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", line).group(1)))


def test_scans_read_only_what_a_view_needs(spark, sf):
    text = plan(spark, sf, "a04_negative_rate")
    assert scanned(text, "lineitem") == {"l_orderkey", "l_partkey"}
    assert scanned(text, "orders") == {"o_orderkey", "o_orderpriority"}
    assert scanned(text, "part") == {"p_partkey", "p_type"}


def test_filters_reach_the_scan(spark, sf):
    text = plan(spark, sf, "f15_one_station")
    assert "EqualTo(s_name,Supplier#000000003)" in text


@pytest.mark.parametrize("name", ["c08_issue", "c11_quality", "n09_tokens", "s07_enriched"])
def test_row_work_does_not_shuffle(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Exchange" not in text


def test_scans_are_dealt_only_where_the_session_states_it(spark, sf):
    assert "RoundRobin" not in plan(spark, sf, "c10_aspects")
    spark.conf.set("spark.forecourt.scanPartitions", "3")
    try:
        assert "RoundRobinPartitioning(3)" in plan(spark, sf, "c10_aspects")
    finally:
        spark.conf.unset("spark.forecourt.scanPartitions")


@pytest.mark.parametrize("name", ["a02_value_counts", "a03_cross_counts", "a13_negative_histogram",
                                  "a15_modes"])
def test_one_scan_of_the_fact_per_answer(spark, sf, name):
    assert plan(spark, sf, name).count("/lineitem.parquet") == 1


def test_terms_are_counted_with_one_shuffle(spark, sf):
    assert plan(spark, sf, "o06_top_terms").count("Exchange hashpartitioning") == 1


def test_no_query_has_a_product_join(spark, sf):
    for name in ("p01_overview", "a02_value_counts", "j01_calendar_spine", "ts08_issue_series",
                 "a15_modes", "ts04_series"):
        text = plan(spark, sf, name)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
