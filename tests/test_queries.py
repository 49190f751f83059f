"""Registered queries against their SQL, and the shape of their plans."""

import re

import pytest

import __spark_entry__ as entry
from tools.check import compare, database
from workload import ORACLES, QUERIES

# Queries whose plan is allowed a Python worker: those that run a caller's code.
PYTHON = {"model_scored_options", "map_batches"}


# Queries whose aggregates are of numbers, or gather what few rows are left: none sorts texts.
HASHED = {"two_turn_only", "first_turn", "render_instruction", "argmax_option", "weighted_draw", "mixture_build"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    assert compare(spark, database(sf_dir), name, sf_dir) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "text", "split"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_plans_stay_in_the_jvm_and_distributed(spark, sf_dir, plan_of, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    for worker in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert worker not in plan
    if name in HASHED:
        assert "SortAggregate" not in plan
    assert _single_task_rows(plan) <= {"_bucket", "_file", "_shard"}


def _single_task_rows(plan):
    """Order columns of windows without partitions: only tables of totals may have one."""
    found = set()
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            spec = re.search(r"windowspecdefinition\((\w+)#\d+L?( ASC| DESC)", line)
            if spec:
                found.add(spec.group(1))
    return found


def test_filters_and_columns_reach_the_scan(spark, sf_dir, plan_of):
    plan = plan_of(entry.queries()["stem_filter"](spark, sf_dir))
    assert "p_retailprice" not in plan and "p_brand" not in plan
    plan = plan_of(entry.queries()["scan_split"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(config" in plan
    assert "text" not in re.search(r"ReadSchema: (\S+)", plan).group(1)
    plan = plan_of(entry.queries()["allow_list"](spark, sf_dir))
    assert "EqualTo(quality,1)" in plan


def test_small_literal_tables_are_broadcast(spark, sf_dir, plan_of):
    plan = plan_of(entry.queries()["map_sources"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
