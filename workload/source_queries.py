"""Queries for sources: records of CSV files that fit their header or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.session import new_table_path
from visitflow.sources.tables import split_sessions_csv
from workload.registry import query
from workload.sessions import table

HEADER = "visitId,comment,status,priority"

RECORDS = """
    select o_orderkey, o_orderstatus, o_orderpriority, case o_orderkey % 8
        when 0 then o_orderkey || ',"a ""quoted"", comma",' || o_orderstatus || ',"' || o_orderpriority || '"'
        when 1 then o_orderkey || ',one,two,three,four'
        when 2 then o_orderkey || ',"short"'
        when 3 then o_orderkey || ',"a, b,' || o_orderstatus || ',' || o_orderpriority
        when 4 then o_orderkey || ',"a"b,' || o_orderstatus || ',' || o_orderpriority
        when 5 then o_orderkey || ',8" inch,' || o_orderstatus || ',' || o_orderpriority
        when 6 then o_orderkey || ',,,'
        else o_orderkey || ',plain,' || o_orderstatus || ',' || o_orderpriority end as record
    from orders
"""


def _records(spark: SparkSession, sf_dir: str) -> str:
    """Folder of CSV files, a part of whose records does not fit the header."""
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.col("o_orderkey") % 8
    ends = F.concat(F.lit(","), status, F.lit(","), priority)
    record = (
        F.when(kind == 0, F.concat(F.lit(',"a ""quoted"", comma",'), status, F.lit(',"'), priority, F.lit('"')))
        .when(kind == 1, ",one,two,three,four")
        .when(kind == 2, ',"short"')
        .when(kind == 3, F.concat(F.lit(',"a, b'), ends))
        .when(kind == 4, F.concat(F.lit(',"a"b'), ends))
        .when(kind == 5, F.concat(F.lit(',8" inch'), ends))
        .when(kind == 6, ",,,")
        .otherwise(F.concat(F.lit(",plain"), ends))
    )
    path = new_table_path(spark, "records-csv")
    lines = table(spark, sf_dir, "orders").select(F.concat(key, record).alias(HEADER))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").option("escape", "").csv(path)
    return path


@query(f"""
    select record, case o_orderkey % 8 when 1 then 'too many fields' when 2 then 'too few fields'
                       when 3 then 'open quote' else 'text behind a quote' end as reason
    from ({RECORDS}) where o_orderkey % 8 in (1, 2, 3, 4)
""")
def csv_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not fit the header, whole, and why."""
    _, bad = split_sessions_csv(spark, _records(spark, sf_dir))
    return bad.select("record", "reason")


@query(f"""
    select cast(o_orderkey as string) as "visitId",
           case o_orderkey % 8 when 0 then 'a "quoted", comma' when 5 then '8" inch' when 7 then 'plain' end as comment,
           case when o_orderkey % 8 <> 6 then o_orderstatus end as status,
           case when o_orderkey % 8 <> 6 then o_orderpriority end as priority
    from ({RECORDS}) where o_orderkey % 8 in (0, 5, 6, 7)
""")
def csv_good_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that fit the header, by column."""
    good, _ = split_sessions_csv(spark, _records(spark, sf_dir))
    return good
