"""Order lines are dealt once: by hand before a broadcast join, else by the join."""

from workload.sessions import line_sessions


def test_lines_are_not_dealt_before_a_join_that_shuffles_them(spark, tmp_path):
    lines = [(1, 7, 1, 2.5, "R"), (1, 8, 2, 3.5, "N"), (2, 7, None, 1.0, "R"), (3, None, 1, 1.0, "R")]
    columns = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "old anvil", "PROMO"), (8, "tin", "SMALL")], "p_partkey bigint, p_name string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet"
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    dealt = {}
    try:
        for most in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            sessions = line_sessions(spark, str(tmp_path))
            plan = sessions._jdf.queryExecution().executedPlan().toString()
            dealt[most] = ("RoundRobin" in plan, sorted(map(tuple, sessions.collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    (first, rows), (second, same) = dealt.values()
    assert first and not second
    assert rows == same and len(rows) == 3
    assert [r[3] is None for r in rows] == [False, False, True]
