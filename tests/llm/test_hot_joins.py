"""Rows of hot keys are dealt by more than their key."""

from pyspark.sql import functions as F

from sparrel.llm import common


def test_the_salt_reaches_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = common.materialise(spark.range(1000).selectExpr("id % 7 as k", "id"), "rows")
        groups = common.materialise(left.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")), "groups")
        out = common.join_by_key(left, groups, "k", 1000, "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(k#") == 1 and ", _s#" in plan.split("hashpartitioning(k#")[1].split(")")[0], plan
        assert out.where("n_rows IS NULL").count() == 0 and out.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
