"""Jobs on tables of cells deal the rows out once and go on within tasks whose size does not grow with the input."""

import os
import re

import pytest

from attestra.plans import answer_queries, book, evidence_queries, fixtures as fx, more_queries, structure_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shuffles(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = book.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_line_items_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fx, "ITEMS", 500)
    tasks = fx.claims(spark, SF).rdd.glom().map(len).collect()
    assert sum(tasks) == fx.table(spark, SF, "lineitem").count() and max(tasks) < 1000 and len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["v17_unit_required_ids", "v4_citation_groups", "d18_chunk_table_rows", "d12_row_context", "s9_encode_evidence"])
def test_rows_are_shuffled_once(spark, name):
    assert shuffles(spark, name) == 1


@pytest.mark.parametrize("name", ["v3_numeric_support", "v6_variant_groups"])
def test_both_sides_are_shuffled_once(spark, name):
    assert shuffles(spark, name) == 2


def test_numeric_context_shuffles_line_items_only(spark):
    assert shuffles(spark, "v7_numeric_table_context") <= 5


def plan_of(spark, name):
    """The plan of a query that writes no table."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    names = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    before = names()
    plan = book.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert names() == before
    return plan


def test_closures_of_packs_write_nothing_and_shuffle_line_items_only(spark):
    plan = plan_of(spark, "v12_citation_closure")
    assert "Join" not in plan
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"l_orderkey"}


def test_hits_on_rows_write_nothing_and_join_nothing(spark):
    plan = plan_of(spark, "e3_expand_rows")
    assert "Join" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3  # line items for cells and for hits, rows with their subjects
