"""Tables rewritten in place, and tables in buckets."""

import pytest
from pyspark.sql import functions as F

from visitflow.operators.evaluate import compare_visitors, visitor_actuals, visitor_predictions, visitor_table, write_by_visitor
from visitflow.operators.model import PREDICTION
from visitflow.sources.versions import ConflictError, commit, current_version, drop_old_versions, publish, read_current, rewrite


def ids(spark, path):
    return sorted(r[0] for r in read_current(spark, path).collect())


def test_rewrite(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_current(spark, path)
    first = publish(spark.range(3).toDF("x"), path)
    before = read_current(spark, path)
    second = rewrite(spark, path, lambda old: old.select((F.col("x") + 10).cast("string").alias("x")))
    assert current_version(spark, path) == second != first
    assert ids(spark, path) == ["10", "11", "12"]
    assert before.count() == 3  # a reader that began earlier still reads the old version
    assert drop_old_versions(spark, path) == 1
    assert ids(spark, path) == ["10", "11", "12"]


def test_a_writer_that_fails_half_way(spark, tmp_path):
    """Some tasks wrote their files, one failed: readers keep the old version, and the next writer goes on from it."""
    path = str(tmp_path / "t")
    publish(spark.range(4, numPartitions=1).toDF("x"), path)
    bad = F.when(F.col("x") == 3, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("x") + 1)
    with pytest.raises(Exception, match="killed"):
        rewrite(spark, path, lambda old: old.repartition(4).select(bad.alias("x")))
    assert ids(spark, path) == [0, 1, 2, 3]
    rewrite(spark, path, lambda old: old.where("x < 3"))
    assert ids(spark, path) == [0, 1, 2]
    assert drop_old_versions(spark, path) >= 1


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(2).toDF("x"), path)

    def slow(old):
        rewrite(spark, path, lambda other: other.withColumn("x", F.col("x") + 100))
        return old

    with pytest.raises(ConflictError):
        rewrite(spark, path, slow)
    assert ids(spark, path) == [100, 101]
    with pytest.raises(ConflictError):
        commit(spark, path, "v-any", None)


def test_buckets_need_no_shuffle(spark, tmp_path):
    scored = spark.range(2000).select(
        (F.col("id") % 90).cast("string").alias("fullVisitorId"), (F.col("id") * 1.0).alias(PREDICTION), F.lit(2.0).alias("total_revenue")
    )
    write_by_visitor(scored, "visitors_in_buckets", 6, str(tmp_path / "b"))
    table = spark.table("visitors_in_buckets")
    joined = compare_visitors(visitor_predictions(table), visitor_actuals(table))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (joined, visitor_table(table)):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, visitor_table(scored).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table visitors_in_buckets")
