"""Queries for profiling, vocabularies, encoding and numeric features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.functions.dates import date_parts, unix_parts
from visitflow.functions.numbers import log1p_capped, log1p_floor
from visitflow.operators.clean import drop_columns
from visitflow.operators.encode import (
    category_label,
    encode_categories,
    fits_broadcast,
    hot_index,
    join_index,
    one_hot,
)
from visitflow.operators.policy import (
    DEFAULT_POLICY,
    apply_policy,
    fit_caps,
    order_columns,
    quantile_caps,
)
from visitflow.operators.profile import (
    describe_numeric,
    profile_columns,
    table_totals,
    top_values,
    value_counts,
)
from visitflow.operators.vocab import (
    dictionary_of,
    index_value,
    rank_categories,
    value_index,
    vocab_sizes,
    vocabulary_spec,
)
from visitflow.session import materialize
from workload.registry import query
from workload.sessions import seconds_of, table


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"""select '{name}' as source, '{c}' as "column", '{t}' as dtype, count({c}) as non_null,
                   count(*) - count({c}) as null_count,
                   count(distinct {c}) + cast(count(*) > count({c}) as bigint) as n_unique,
                   count(distinct {c}) + cast(count(*) > count({c}) as bigint) <= 1 as low_variance
            from {name}_x"""
        for c, t in columns.items()
    )


CUSTOMER_TYPES = {
    "c_custkey": "bigint",
    "c_name": "string",
    "c_nationkey": "int",
    "c_acctbal": "double",
    "c_mktsegment": "string",
    "sparse": "string",
    "nothing": "string",
}
EVENT_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}


@query(f"""
    with customer_x as (select *, case when c_nationkey = 3 then c_name end as sparse,
                               cast(null as string) as nothing from customer),
         events_x as (select event_id, ts, user_id, event_type, value, props from events)
    {_profile_sql("customer", CUSTOMER_TYPES)} union all {_profile_sql("events", EVENT_TYPES)}
""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, counts and distinct values of every column of two tables."""
    customer = table(spark, sf_dir, "customer").withColumns(
        {
            "sparse": F.when(F.col("c_nationkey") == 3, F.col("c_name")),
            "nothing": F.lit(None).cast("string"),
        }
    )
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    parts = [
        profile_columns(df).select(F.lit(name).alias("source"), "*")
        for name, df in (("customer", customer), ("events", events))
    ]
    return parts[0].unionByName(parts[1])


@query("""select count(*) as "rows", cast(11 as bigint) as "columns" from lineitem""")
def row_and_column_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a table."""
    return table_totals(table(spark, sf_dir, "lineitem"))


MEASURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax"]


def _describe_sql(c: str) -> str:
    def quartile(q: float) -> str:
        return f"max(case when rn = cast(floor((n - 1) * {q} + 0.5) as bigint) then x end)"

    return f"""
        select '{c}' as "column", count(x) as "count", count(*) - count(x) as null_count,
               round(avg(x), 7) as mean, round(stddev_samp(x), 7) as std, min(x) as min,
               {quartile(0.25)} as q25, {quartile(0.5)} as q50, {quartile(0.75)} as q75, max(x) as max
        from (select *, row_number() over (order by x) - 1 as rn, count(x) over () as n
              from (select {c}::double as x from lineitem))
    """


@query(" union all ".join(_describe_sql(c) for c in MEASURES))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread, range and exact quartiles of numeric columns."""
    return describe_numeric(table(spark, sf_dir, "lineitem")).withColumns(
        {"mean": F.round("mean", 7), "std": F.round("std", 7)}
    )


def _counts_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {c} as value, count(*) as n from {source} group by {c}"""
        for c in columns
    )


def _top_sql(counts: str, k: int = 15) -> str:
    return f"""
        select * from (select *, cast(row_number() over (partition by "column"
                                    order by n desc, value nulls first) as int) as "rank"
                       from ({counts})) where "rank" <= {k}
    """


@query(_top_sql(_counts_sql("part", ["p_name", "p_brand", "p_type", "p_size::varchar"]).replace("'p_size::varchar'", "'p_size'")))
def top_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent values per column."""
    columns = ["p_name", "p_brand", "p_type", "p_size"]
    return top_values(value_counts(table(spark, sf_dir, "part").select(columns)))


CATEGORIES = ["p_brand", "p_type", "p_name"]
# Values with reserved texts and blanks among them, by the same rule on both sides.
CATEGORY_SQL = """
    select p_partkey, p_size,
           case p_size when 1 then '(not set)' when 2 then '' when 3 then '(Other)' when 4 then 'UNKNOWN'
                       when 5 then ' ' || p_brand || ' ' else p_brand end as p_brand,
           case p_type when 'PROMO' then null else p_type end as p_type, p_name
    from part
"""
RESERVED_SQL = """
    coalesce(trim(value) in ('', '(not provided)', 'None', 'not available in demo dataset', '(not set)',
        'Unknown', 'not set', 'unknown', 'unknown.unknown', '(Other)')
        or lower(value) in ('none', 'unknown', 'not set'), true)
"""
KEPT_SQL = f"""
    select "column", value, row_number() over (partition by "column" order by r) + 1 as index
    from (select "column", trim(value) as value, min("rank") as r
          from ({_top_sql(_counts_sql("cats", CATEGORIES))}) where not {RESERVED_SQL}
          group by all)
"""
SPEC_SQL = f"""
    select u."column", u.requested_top_k, coalesce(k.top_n, 0) as top_n,
           coalesce(k.top_n, 0) + 2 as others_index, coalesce(k.top_n, 0) + 3 as vocab_size, k.names
    from (select "column", count(*) as requested_top_k
          from ({_counts_sql("cats", CATEGORIES)}) group by 1) u
    left join (select "column", count(*) as top_n, list(value order by index) as names
               from kept group by 1) k using ("column")
"""
WITH_VOCABULARY = f"with cats as ({CATEGORY_SQL}), kept as ({KEPT_SQL}), spec as ({SPEC_SQL})"


def category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, brand = F.col("p_size"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_size",
        F.when(size == 1, "(not set)")
        .when(size == 2, "")
        .when(size == 3, "(Other)")
        .when(size == 4, "UNKNOWN")
        .when(size == 5, F.concat(F.lit(" "), brand, F.lit(" ")))
        .otherwise(brand)
        .alias("p_brand"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type"),
        "p_name",
    )


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(category_table(spark, sf_dir), CATEGORIES)


def category_dictionary(spark: SparkSession, sf_dir: str) -> dict:
    return dictionary_of(vocabulary_spec(category_counts(spark, sf_dir)), CATEGORIES)


@query(f"""{WITH_VOCABULARY} select "column", value, cast(index as bigint) as index from kept""")
def vocabulary_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained values of each column with their indices."""
    return rank_categories(category_counts(spark, sf_dir))


@query(f"""
    {WITH_VOCABULARY}
    select "column", requested_top_k, top_n, cast(2 as bigint) as reserved, others_index, vocab_size,
           array_to_string(names, '|') as categories
    from spec
""")
def vocabulary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of each column: sizes and ordered categories."""
    spec = vocabulary_spec(category_counts(spark, sf_dir))
    return spec.withColumn("categories", F.array_join("top_categories_order", "|")).drop(
        "top_categories_order"
    )


@query(f"""
    {WITH_VOCABULARY}
    select "column", value, cast(index as bigint) as index from kept
    union all
    select "column", v.value, case v.index when -1 then others_index else v.index end
    from spec cross join (values ('__NONE__', 0), ('__UNKNOWN__', 1), ('__OTHER__', -1), ('', 0), (' ', 0),
        ('(not provided)', 0), ('None', 0), ('not available in demo dataset', 0), ('(not set)', 1),
        ('Unknown', 1), ('not set', 1), ('unknown', 1), ('unknown.unknown', 1), ('(Other)', -1)) v(value, index)
""")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value to index, with labels and placeholder texts."""
    return value_index(vocabulary_spec(category_counts(spark, sf_dir)))


@query(f"""
    {WITH_VOCABULARY}
    select "column", cast(index as bigint) as index, value from kept
    union all select "column", 0, '__NONE__' from spec
    union all select "column", 1, '__UNKNOWN__' from spec
    union all select "column", others_index, '__OTHER__' from spec
""")
def vocabulary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index to label or category."""
    return index_value(vocabulary_spec(category_counts(spark, sf_dir)))


def _encoded_sql(c: str) -> str:
    # The reserved texts are looked up as they are, so UNKNOWN falls to the others.
    return f"""
        case when {c} is null or trim({c}) in ('', 'nan', 'None') then 0
             when {c} = '(not set)' then 1
             else coalesce((select index from kept where "column" = '{c}' and value = trim({c})),
                           (select others_index from spec where "column" = '{c}')) end
    """


ENCODED_SQL = f"""
    {WITH_VOCABULARY}
    select p_partkey, p_size, {", ".join(f"cast({_encoded_sql(c)} as bigint) as {c}" for c in CATEGORIES)}
    from cats
"""


@query(ENCODED_SQL)
def encode_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories replaced by their index with a fitted vocabulary."""
    return encode_categories(category_table(spark, sf_dir), category_dictionary(spark, sf_dir))


@query(ENCODED_SQL)
def encode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup as a join with the vocabulary table."""
    spec = materialize(vocabulary_spec(category_counts(spark, sf_dir)), "vocabulary")
    index = materialize(value_index(spec), "vocabulary-index")
    encoded = category_table(spark, sf_dir)
    for name in CATEGORIES:
        lookup = index.filter(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("index").alias("_index")
        )
        others = spec.filter(F.col("column") == name).first()["others_index"]
        encoded = join_index(encoded, name, lookup, others, broadcast=fits_broadcast(lookup))
    return encoded


@query(ENCODED_SQL)
def encode_by_shuffled_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup as it runs for a vocabulary too large to broadcast: frequent values apart, the rest joined by shuffle."""
    spec = materialize(vocabulary_spec(category_counts(spark, sf_dir)), "vocabulary")
    index = materialize(value_index(spec), "vocabulary-index")
    categories = encoded = category_table(spark, sf_dir)
    others = {r["column"]: r["others_index"] for r in spec.select("column", "others_index").collect()}
    for name in CATEGORIES:
        lookup = index.filter(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("index").alias("_index")
        )
        hot = hot_index(categories, name, lookup, others[name])
        encoded = join_index(encoded, name, lookup.hint("merge"), others[name], hot=hot)
    return encoded


@query(f"""
    select p_partkey, case p_type when 0 then '__NONE__' else coalesce(
        (select value from ({WITH_VOCABULARY} select value from kept where "column" = 'p_type' and index = e.p_type)),
        '__OTHER__') end as p_type
    from ({ENCODED_SQL}) e
""")
def decode_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices shown as labels."""
    dictionary = category_dictionary(spark, sf_dir)
    encoded = encode_categories(category_table(spark, sf_dir), dictionary)
    labels = dictionary["columns"]["p_type"]["index_to_value"]
    return encoded.select("p_partkey", category_label(F.col("p_type"), labels).alias("p_type"))


def _hot_sql(c: str, size: int) -> str:
    return ", ".join(f"cast({c} = {i} as tinyint) as {c}_{i}" for i in range(size))


@query(f"""
    select p_partkey, p_size, {_hot_sql("p_brand", 14)}, {_hot_sql("p_type", 8)},
           cast(0 as tinyint) as absent_0, cast(0 as tinyint) as absent_1
    from (select * replace (least(p_brand, 13) as p_brand, least(p_type, 7) as p_type) from ({ENCODED_SQL}))
""")
def one_hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices as byte columns; one vocabulary shorter than its indices, one column absent."""
    dictionary = category_dictionary(spark, sf_dir)
    encoded = encode_categories(category_table(spark, sf_dir), dictionary).drop("p_name")
    sizes = {"p_brand": 14, "p_type": vocab_sizes(dictionary)["p_type"], "absent": 2}
    return one_hot(encoded, sizes)


@query("""
    select 'price' as field, round(quantile_cont(l_extendedprice, 0.99), 6) as cap from lineitem
    union all select 'discounted', round(quantile_cont(coalesce(case when l_linenumber <> 1
              then l_extendedprice * l_discount end, 0), 0.95), 6) from lineitem
    union all select 'quantity', round(quantile_cont(l_quantity, 0.5), 6) from lineitem
""")
def fitted_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of several fields in shared scans."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice") * F.col("l_discount")).alias(
            "discounted"
        ),
        F.col("l_quantity").alias("quantity"),
    )
    caps = quantile_caps(lines, {"price": 0.99, "discounted": 0.95, "quantity": 0.5})
    return spark.createDataFrame(list(caps.items()), "field string, cap double").withColumn(
        "cap", F.round("cap", 6)
    )


@query("""
    with caps as (select quantile_cont(l_quantity, 0.9) as cap from lineitem)
    select l_orderkey, l_linenumber, round(ln(1 + least(l_quantity, (select cap from caps))), 6)
           as total_product_viewed
    from lineitem
""")
def cap_from_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap that is not stored is fitted on the whole input."""
    policy = {"features": [{"field": "total_product_viewed", "action": "log1p_cap", "cap_quantile": 0.9}]}
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("total_product_viewed")
    )
    return apply_policy(lines, policy).withColumn(
        "total_product_viewed", F.round("total_product_viewed", 6)
    )


@query("""
    with caps as (select quantile_cont(l_extendedprice, 0.99) as price, quantile_cont(l_quantity, 0.99) as q
                  from lineitem)
    select cast(l_orderkey as string) as fullVisitorId, cast(l_linenumber as string) as visitId,
           round(ln(1 + coalesce(case when l_returnflag = 'R' then l_extendedprice end, 0)), 6) as total_revenue,
           round(ln(1 + least(l_quantity, q)), 6) as total_product_viewed,
           round(ln(1 + greatest(l_quantity - 10, 0)), 6) as totals_hits,
           round(ln(1 + least(l_extendedprice, price)), 6) as average_price_product_viewed,
           (date_part('isodow', l_shipdate) - 1)::int as date_dow,
           date_part('month', l_shipdate)::int as date_month,
           (date_part('isodow', l_shipdate) >= 6)::int as date_is_weekend,
           l_linestatus
    from lineitem, caps
""")
def numeric_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage drop, log, capped log and calendar parts in one projection, ordered."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.date_format("l_shipdate", "yyyyMMdd").cast("bigint").alias("date"),
        F.col("l_quantity").alias("total_product_viewed"),
        F.col("l_linenumber").cast("string").alias("visitId"),
        F.col("l_orderkey").cast("string").alias("fullVisitorId"),
        (F.col("l_quantity") - 10).alias("totals_hits"),
        F.col("l_extendedprice").alias("average_price_product_viewed"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("total_revenue"),
        F.col("l_tax").alias("totals_transactionRevenue"),
    )
    logged = ["total_revenue", "total_product_viewed", "totals_hits", "average_price_product_viewed"]
    result = order_columns(apply_policy(lines, fit_caps(lines, DEFAULT_POLICY)), [])
    return result.withColumns({c: F.round(c, 6) for c in logged})


@query("""
    select event_id, round(ln(1 + greatest(value - 20, 0)), 6) as logged,
           round(ln(1 + least(value, 181)), 6) as capped
    from events
""")
def log_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floored log and capped log of one column."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(log1p_floor(F.col("value") - 20), 6).alias("logged"),
        F.round(log1p_capped(F.col("value"), 181.0), 6).alias("capped"),
    )


@query("""
    select o_orderkey,
           case when o_orderstatus <> 'P' then date_part('isodow', o_orderdate)::int - 1 end as date_dow,
           case when o_orderstatus <> 'P' then date_part('month', o_orderdate)::int end as date_month,
           case o_orderstatus when 'P' then 0 else (date_part('isodow', o_orderdate) >= 6)::int end
               as date_is_weekend
    from orders
""")
def date_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar parts of YYYYMMDD numbers; impossible dates give weekend 0."""
    number = F.when(F.col("o_orderstatus") == "P", F.lit(20180230.0)).otherwise(
        F.date_format("o_orderdate", "yyyyMMdd").cast("double")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", number.alias("d"))
    return orders.select("o_orderkey", *[c.alias(n) for n, c in date_parts(F.col("d")).items()])


@query("""
    select event_id, case when event_type <> 'error' then date_part('hour', ts)::int end as vst_hour,
           case when event_type <> 'error' then date_part('isodow', ts)::int - 1 end as vst_dow,
           case event_type when 'error' then 0 else (date_part('isodow', ts) >= 6)::int end as vst_is_weekend
    from events
""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour and weekday of unix seconds in UTC; a missing time gives weekend 0."""
    seconds = F.when(F.col("event_type") != "error", seconds_of("ts").cast("double"))
    events = table(spark, sf_dir, "events").select("event_id", seconds.alias("s"))
    return events.select("event_id", *[c.alias(n) for n, c in unix_parts(F.col("s")).items()])


@query("""
    select cast(event_id as string) as visitId, value as total_revenue, event_type as zzz
    from events
""")
def leakage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage columns of the policy dropped, the others ordered."""
    policy = {
        "features": [
            {"field": "totals_transactions", "action": "drop"},
            {"field": "totals_transactionRevenue", "action": "drop"},
        ]
    }
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("zzz"),
        F.col("user_id").alias("totals_transactions"),
        F.col("value").alias("total_revenue"),
        F.col("event_id").cast("string").alias("visitId"),
    )
    return drop_columns(order_columns(apply_policy(events, policy), []), ["not_there"])
