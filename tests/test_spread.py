"""Rows whose cells are parsed are dealt over tasks that grow in number."""

from visitflow.sources.tables import ROWS_PER_TASK, spread_rows


def test_tasks_grow_with_the_rows(spark):
    scan = spark.range(0, 9 * ROWS_PER_TASK, 1, 4)
    spread = spread_rows(scan)
    assert spread.rdd.getNumPartitions() == 9
    assert spread.count() == scan.count() and spread.distinct().count() == scan.count()
    assert spread_rows(spark.range(0, 10, 1, 2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_rows(spark.range(0, 10, 1, 20)).rdd.getNumPartitions() == 20
