"""What the physical plans may contain."""

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import Ahead, Behind, Latest, Running, Timeline
from registry import ORACLES, QUERIES

from .conftest import SMALL


def plan_of(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        return again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def nodes(plan, name):
    return [line for line in plan.splitlines()
            if line.lstrip(" :+-*()0123456789").startswith(name)]


def test_event_table_shuffles_the_log_once(spark):
    plan = plan_of(QUERIES["event_table"](spark, SMALL))
    # One by session, one for the handful of dictionary entries.
    assert len(nodes(plan, "Exchange")) == 2
    assert len(nodes(plan, "BroadcastExchange")) == 2
    # Numbering, and one for the look-ups of all three passes.
    assert len(nodes(plan, "Sort [")) <= 4
    assert not nodes(plan, "SortMergeJoin")


def test_event_table_of_a_laid_out_log_does_not_shuffle_it(spark):
    plan = plan_of(QUERIES["event_table_laid_out"](spark, SMALL))
    # The one of the handful of dictionary entries.
    assert len(nodes(plan, "Exchange")) == 1
    assert "Bucketed: true" in plan
    assert not nodes(plan, "SortMergeJoin")


def test_event_table_reads_only_what_it_needs(spark):
    plan = plan_of(QUERIES["event_table"](spark, SMALL))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "value" not in scan and "props" not in scan


def test_all_looks_share_one_shuffle(spark):
    df = spark.range(50).selectExpr("id % 3 AS session_id", "id AS seq", "id % 7 = 0 AS hit")
    line, v, hit = Timeline(), F.col("seq"), F.col("hit")
    plan = plan_of(line.look(df, a=Ahead(v, hit), b=Behind(v, hit, 3), c=Latest(v), d=Running(v)))
    assert len(nodes(plan, "Exchange")) == 1
    assert len(nodes(plan, "Sort [")) == 1
    assert len(nodes(plan, "Window [")) == 1


@pytest.mark.parametrize("name", ["event_table", "state_dig", "mirror_partner", "explode_sizes"])
def test_no_python_in_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
