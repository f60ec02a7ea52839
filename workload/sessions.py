"""Raw sessions made of the benchmark tables, row by row.

One row gives one session whose cells are texts, as in a raw export. No
grouping is needed, so the work grows with the table and no cell with its skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.sources.tables import is_broadcast, spread_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_of(timestamp: str) -> Column:
    """Unix seconds of a time of day without a zone, taken as UTC."""
    return F.expr(
        f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({timestamp} as timestamp_ntz))"
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


MOST_HITS = 3


def _hits(n: Column, hit) -> Column:
    """Python literal of ``n`` hits, 1 to :data:`MOST_HITS`; one that would hold a null is left out. Null for no number."""
    each = [F.when(n >= i, hit(F.lit(i))) for i in range(1, MOST_HITS + 1)]
    return F.when(n.isNotNull(), _text("[", F.concat_ws(", ", *each), "]"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw session columns, one session per event."""
    e = spread_rows(table(spark, sf_dir, "events"))
    kind, number = F.col("event_type"), F.col("event_id")
    n_hits = 1 + F.pmod(number, F.lit(MOST_HITS))
    cents = F.round(F.col("value") * 100).cast("bigint")
    micros = cents * 10000

    def hit(i: Column) -> Column:
        category = (
            F.when(i == 2, _text("Home/Shop/", kind, "/"))
            .when(i == 3, "Home/Third/")
            .otherwise("(not set)")
        )
        action = F.when((kind == "purchase") & (i == n_hits), F.lit("6")).otherwise(F.lit("0"))
        return _text(
            "{'hitNumber': '", i, "', 'isEntrance': True, 'item': None, ",
            "'product': [{'productPrice': '", micros * i, "', 'v2ProductName': \"Men's True Tee\", ",
            "'v2ProductCategory': '", category, "'}], ",
            "'eCommerceAction': {'action_type': '", action, "'}, ",
            "'transaction': {'transactionRevenue': '", micros * i, "'}}",
        )

    totals_end = (
        F.when(kind == "signup", _text(',"totalTransactionRevenue":"', micros * 2, '"'))
        .when(kind == "click", F.lit(',"transactionRevenue":"0","totalTransactionRevenue":"7"'))
        .otherwise("")
    )
    return e.select(
        kind.alias("channelGrouping"),
        F.date_format("ts", "yyyyMMdd").cast("bigint").alias("date"),
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("fullVisitorId"),
        number.cast("string").alias("visitId"),
        (1 + F.pmod(F.col("user_id"), F.lit(7))).alias("visitNumber"),
        seconds_of("ts").alias("visitStartTime"),
        F.lit("Not Socially Engaged").alias("socialEngagementType"),
        F.when(kind == "error", "[]")
        .otherwise(_text("[{'index': '4', 'value': '", F.upper(kind), "'}]"))
        .alias("customDimensions"),
        _text(
            '{"browser":"', kind, '","isMobile":', F.when(F.pmod(number, F.lit(2)) == 0, "true").otherwise("false"),
            ',"browserSize":"not available in demo dataset"}',
        ).alias("device"),
        _text('{"country":"C', F.pmod(F.col("user_id"), F.lit(20)), '"}').alias("geoNetwork"),
        _text(
            '{"visits":"1","hits":"', n_hits, '","pageviews":"', 1 + F.pmod(number, F.lit(17)), '"', totals_end, "}"
        ).alias("totals"),
        F.when(kind == "view", _text('{"source":"(direct)","adwordsClickInfo":{"page":"', n_hits, '"}}'))
        .otherwise('{"source":"(direct)","adwordsClickInfo":{}}')
        .alias("trafficSource"),
        _hits(n_hits, hit).alias("hits"),
    )


def line_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of order lines: products with prices and part categories."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    # A join that shuffles deals the lines itself.
    joined = (spread_rows(lines) if is_broadcast(parts) else lines).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    n_hits = 1 + F.pmod(F.col("l_linenumber"), F.lit(MOST_HITS))
    micros = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10000
    action = F.when(F.col("l_returnflag") == "R", F.lit("6")).otherwise(F.lit("2"))

    def hit(i: Column) -> Column:
        category = (
            F.when(i == 1, _text("Home/", F.col("p_type"), "/", F.col("p_name"), "/"))
            .when(i == 2, _text("Home/", F.col("p_type")))
            .otherwise("(not set)")
        )
        return _text(
            "{'hitNumber': '", i, "', 'isEntrance': False, 'referer': None, ",
            "'product': [{'productPrice': '", micros * i, "', 'v2ProductCategory': '", category, "'}], ",
            "'eCommerceAction': {'action_type': '", action, "'}, ",
            "'transaction': {'transactionRevenue': '", micros, "'}}",
        )

    return joined.select("l_orderkey", "l_partkey", "l_linenumber", _hits(n_hits, hit).alias("hits"))


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of orders: some with revenue in the hits, others in the totals."""
    micros = F.round(F.col("o_totalprice") * 100).cast("bigint") * 10000
    urgent = F.col("o_orderpriority").startswith("1")
    hits = F.when(
        urgent, _text("[{'eCommerceAction': {'action_type': '6'}, 'transactionRevenue': '", micros, "'}]")
    ).otherwise("[{'eCommerceAction': {'action_type': '2'}, 'transactionRevenue': '5'}]")
    totals = (
        F.when(F.col("o_orderstatus") == "O", _text('{"transactionRevenue":"', micros * 2, '"}'))
        .when(
            F.col("o_orderstatus") == "F",
            _text('{"transactionRevenue":"","totalTransactionRevenue":"', micros * 3, '"}'),
        )
        .otherwise('{"transactionRevenue":"0","totalTransactionRevenue":"9000000"}')
    )
    return spread_rows(table(spark, sf_dir, "orders")).select(
        "o_orderkey", hits.alias("hits"), totals.alias("totals")
    )
