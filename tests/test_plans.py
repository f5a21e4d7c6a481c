"""What Spark makes of the frames: pushdown, join types, skew handling, no Python."""

import pytest
from pyspark.sql import functions as F

from provframe import BX, NX, N, annotate, session
from provframe.plans import catalogue
from provframe.plans.registry import tables
from provframe.plans.tpch import ADAPTED

from .conftest import SF_SMALL


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(ADAPTED))
@pytest.mark.parametrize("semiring", ["B", "N", "B[X]", "N[X]"])
def test_products_become_equi_joins(spark, name, semiring):
    df = ADAPTED[name].frame(tables(spark, SF_SMALL, semiring)).merge().df
    plan = executed(df)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "BatchEval" not in plan


def test_chained_products_are_reordered(spark):
    for s in ("B", "B[X]", "N[X]"):
        t = tables(spark, SF_SMALL, s)
        chain = (
            t.supplier.cross(t.customer).cross(t.lineitem).cross(t.orders)
            .where("l_suppkey = s_suppkey AND o_custkey = c_custkey AND l_orderkey = o_orderkey")
        )
        assert "Cartesian" not in executed(chain.df) and "NestedLoop" not in executed(chain.df)


def test_filters_and_columns_reach_the_scan(spark):
    q = ADAPTED["q3"].frame(tables(spark, SF_SMALL, "B[X]")).merge().df
    plan = q._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "GreaterThan(l_shipdate,1998-03-15T00:00)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_existence_needs_no_witness_columns(spark):
    t = tables(spark, SF_SMALL, "B[X]")
    plan = optimized(t.orders.join(t.customer, [("o_custkey", "c_custkey")]).project("c_nationkey").support())
    assert "struct(" not in plan


def test_counting_is_preaggregated(spark):
    t = tables(spark, SF_SMALL, "N")
    plan = executed(t.lineitem.project("l_returnflag").merge().df)
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "decimal" not in plan.split("Exchange")[1]  # the rows are counted as longs


def test_one_shuffle_per_merge(spark):
    t = tables(spark, SF_SMALL, "B[X]")
    plan = executed(t.lineitem.project("l_returnflag").merge().df)
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


@pytest.fixture
def shuffled(spark):
    """Small partitions and no broadcast, so that adaptive skew handling shows on little data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot(spark, semiring, n=30_000):
    """A third of all rows has key 0."""
    facts = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), "id"
    )
    dims = spark.range(1000).select(F.col("id").alias("d"), (F.col("id") % 7).alias("g"))
    return annotate(facts, semiring, "f", ["id"]), annotate(dims, semiring, "d", ["d"])


@pytest.mark.parametrize("semiring", [N, BX, NX], ids=["N", "B[X]", "N[X]"])
def test_hot_join_keys_are_split(spark, shuffled, semiring):
    facts, dims = hot(spark, semiring)
    joined = facts.join(dims, [("k", "d")])
    df = joined.df
    assert df.count() == 30_000
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    assert "skew=true" in executed(df)


def test_hot_outer_and_anti_joins(spark, shuffled):
    facts, dims = hot(spark, N)
    some = dims.where("d < 10 OR d > 990")
    left = some.left_outer(facts.where("id % 2 = 0"), [("d", "k")])
    want = spark.sql(
        "SELECT count(*) FROM (SELECT id AS d FROM range(1000) WHERE id < 10 OR id > 990) a LEFT JOIN "
        "(SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE id % 1000 END AS k FROM range(30000) WHERE id % 2 = 0) b "
        "ON a.d = b.k"
    ).first()[0]
    assert left.df.count() == want
    assert dims.anti(facts, [("d", "k")]).df.count() == 1000 - facts.df.select("k").distinct().count()


def test_hot_tuple_is_spread_over_reducers(spark, shuffled):
    facts, _ = hot(spark, BX)
    merged = facts.project("k").merge().df
    per_task = merged.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 30_000 / 3


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_an_outer_join_of_own_variables_is_not_absorbed(spark):
    plan = catalogue.QUERIES["x_outer_bx"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "__ak" not in plan
    planned = catalogue.QUERIES["x_outer_bx"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # Two joins, and twice the moves that text() makes of its rows and counts.
    assert planned.count("Exchange hashpartitioning") <= 16


def test_shuffles_fit_what_they_move(spark):
    try:
        session.tune(spark, 10 * 2**40)
        assert int(spark.conf.get(session.INITIAL_PARTITIONS)) == 163_840
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS)


def test_range_joins_are_no_nested_loops(spark):
    for name in ("join_range_bx", "join_range_days_bx", "x_anti_theta_nat", "x_outer_theta_nat"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = executed(catalogue.QUERIES[name](spark, SF_SMALL))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_key_of_an_outer_join_with_a_condition(spark, shuffled):
    facts, dims = hot(spark, N)
    some = dims.where("d < 10")
    for where, sql in (("id % 2 = 0", "b.id % 2 = 0"), ("id % 7 = g", "b.id % 7 = a.d % 7")):
        left = some.left_outer(facts, [("d", "k")], where=where)
        want = spark.sql(
            "SELECT count(*) FROM (SELECT id AS d FROM range(1000) WHERE id < 10) a LEFT JOIN "
            "(SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 1000 END AS k FROM range(30000)) b "
            f"ON a.d = b.k AND {sql}"
        ).first()[0]
        assert left.df.count() == want
