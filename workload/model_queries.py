"""Queries for splits, preparation, models, evaluation, sources and pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.operators.encode import encode_categories
from visitflow.operators.evaluate import (
    compare_visitors,
    evaluation_report,
    regression_metrics,
    visitor_actuals,
    visitor_predictions,
    visitor_table,
    visitors_missing,
)
from visitflow.operators.flatten import discover_leaves
from visitflow.operators.model import (
    PREDICTION,
    DenseLayer,
    DenseNet,
    fit_regressor,
    floor_at_zero,
    score,
    score_dense,
)
from visitflow.operators.net import fit_net
from visitflow.operators.prep import apply_prep, fit_prep, numeric_features, split_features
from visitflow.operators.split import first_rows, sample_rows, time_split
from visitflow.operators.vocab import fit_vocabulary, vocab_sizes
from visitflow.plans.pipeline import FittedPipeline, fit_pipeline, fit_transform
from visitflow.plans.training import train_and_evaluate
from visitflow.session import materialize, new_table_path
from visitflow.sources.params import load_version, save_version, write_report
from visitflow.sources.tables import (
    read_parts_relaxed,
    read_sessions_csv,
    read_table,
    rows_per_part,
    union_relaxed,
    write_csv,
    write_table,
)
from workload.feature_queries import ENCODED_SQL, category_dictionary, category_table
from workload.flatten_queries import CLEAN
from workload.registry import query
from workload.sessions import event_sessions, table


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model input: identifiers, label and a few features."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("fullVisitorId"),
        F.col("event_id").cast("string").alias("visitId"),
        F.col("value").alias("total_revenue"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("spend"),
        F.col("user_id").alias("visitor"),
        F.lit(7.0).alias("constant"),
    )


SPLIT_SQL = """
    select user_id::varchar as fullVisitorId, event_id::varchar as visitId, value as total_revenue,
           case when event_type <> 'error' then value end as spend, user_id as visitor, 7.0::double as constant,
           row_number() over (order by event_id::varchar) as rn, count(*) over () as n
    from events
"""


@query(f"""
    select visitId, case when rn <= floor(n * 0.9) then 'train' else 'validation' end as part
    from ({SPLIT_SQL})
""")
def time_ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First nine tenths of the rows by text key, and the rest."""
    train, validation = time_split(event_rows(spark, sf_dir))
    return (
        train.select("visitId", F.lit("train").alias("part"))
        .unionByName(validation.select("visitId", F.lit("validation").alias("part")))
    )


@query(f"select visitId, total_revenue from ({SPLIT_SQL}) where rn <= 1234")
def first_rows_by_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First N rows in key order."""
    return first_rows(event_rows(spark, sf_dir), 1234).select("visitId", "total_revenue")


@query("""
    select * replace (strftime(o_orderdate, '%Y-%m-%d') as o_orderdate) from orders
    order by ('0x' || substr(md5('42/' || o_orderkey), 1, 15))::bigint limit 500
""")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly N rows picked by a seeded hash."""
    picked = sample_rows(table(spark, sf_dir, "orders"), 500, keys=["o_orderkey"])
    return picked.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


PREP_SQL = f"""
    with rows as ({SPLIT_SQL}),
         train as (select * from rows where rn <= floor(n * 0.9)),
         fill as (select median(spend) as spend from train),
         stats as (select avg(coalesce(t.spend, f.spend)) as m_spend, stddev_pop(coalesce(t.spend, f.spend)) as s_spend,
                          avg(visitor) as m_visitor, stddev_pop(visitor) as s_visitor from train t, fill f),
         prepared as (
             select visitId, fullVisitorId, total_revenue, rn, n,
                    greatest(-1.5, least(1.5, (coalesce(r.spend, f.spend) - m_spend) / s_spend)) as spend,
                    greatest(-1.5, least(1.5, (visitor - m_visitor) / s_visitor)) as visitor
             from rows r, fill f, stats)
"""


@query(f"""
    {PREP_SQL}
    select visitId, round(spend, 6) as spend, round(visitor, 6) as visitor, 0.0::double as constant
    from prepared
""")
def impute_scale_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median fill and scaling fitted on the train split, applied to all rows."""
    rows = event_rows(spark, sf_dir)
    train, _ = time_split(rows)
    ready = apply_prep(rows, fit_prep(train), keep=["visitId"], bound=1.5)
    return ready.select(
        "visitId", *[F.round(c, 6).alias(c) for c in ("spend", "visitor", "constant")]
    )


@query(f"""
    {PREP_SQL}
    select visitId, round((m - m_spend) / s_spend, 6) as spend, 0.0::double as constant
    from prepared, stats, (select spend as m from fill)
""")
def align_to_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New data without a training column and with an extra one."""
    rows = event_rows(spark, sf_dir)
    train, _ = time_split(rows)
    prep = fit_prep(train, ["spend", "constant"])
    new = rows.select("visitId", "constant", F.col("visitor").alias("extra"))
    return apply_prep(new, prep, keep=["visitId"]).withColumn("spend", F.round("spend", 6))


@query(f"""
    select p_partkey, p_brand, p_size::double as p_size from ({ENCODED_SQL})
""")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features told apart: categorical by the vocabulary, numeric by type."""
    dictionary = category_dictionary(spark, sf_dir)
    encoded = encode_categories(category_table(spark, sf_dir).drop("p_type", "p_name"), dictionary)
    features, _ = numeric_features(encoded)
    categorical, numeric = split_features(features, dictionary)
    size = [c for c in numeric if c != "p_partkey"]
    return encoded.select("p_partkey", *categorical, *[F.col(c).cast("double") for c in size])


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a formula in the place of a model."""
    formula = F.col("value") * 0.5 + F.col("user_id") * 0.01 - 5
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") != 3, F.col("user_id").cast("string")).alias("fullVisitorId"),
        F.col("value").alias("total_revenue"),
        formula.alias("raw"),
        floor_at_zero(formula).alias(PREDICTION),
    )


SCORED_SQL = """
    select case when user_id <> 3 then user_id::varchar end as fullVisitorId, value as total_revenue,
           value * 0.5 + user_id * 0.01 - 5 as raw, greatest(value * 0.5 + user_id * 0.01 - 5, 0) as p
    from events
"""
VISITORS_SQL = f"""
    select fullVisitorId, sum(p) as p, sum(total_revenue) as a from ({SCORED_SQL})
    where fullVisitorId is not null group by 1
"""


def _metrics_sql(source: str, p: str, a: str) -> str:
    return f"""
        select count(*) as n, round(sqrt(avg(({a} - {p}) ** 2)), 6) as rmse,
               round(avg(abs({a} - {p})), 6) as mae,
               round(1 - avg(({a} - {p}) ** 2) / var_pop({a}), 6) as r2
        from ({source})
    """


@query(f"""select fullVisitorId, round(p, 4) as "PredictedLogRevenue" from ({VISITORS_SQL})""")
def predictions_per_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floored predictions summed per visitor."""
    return visitor_predictions(scored_events(spark, sf_dir)).withColumn(
        PREDICTION, F.round(PREDICTION, 4)
    )


@query(f"""
    select fullVisitorId, round(p, 4) as "PredictedLogRevenue", round(a, 4) as actual from ({VISITORS_SQL})
""")
def visitor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions joined with the actual sums."""
    scored = scored_events(spark, sf_dir)
    compared = compare_visitors(visitor_predictions(scored), visitor_actuals(scored))
    return compared.withColumns({c: F.round(c, 4) for c in (PREDICTION, "actual")})


@query(_metrics_sql(VISITORS_SQL, "p", "a"))
def visitor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and R2 per visitor with one shuffle."""
    table_ = visitor_table(scored_events(spark, sf_dir))
    metrics = regression_metrics(table_, F.col(PREDICTION), F.col("actual"))
    return metrics.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})


@query(_metrics_sql(SCORED_SQL, "raw", "total_revenue"))
def row_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and R2 per row, predictions as they are."""
    metrics = regression_metrics(
        scored_events(spark, sf_dir), F.col("raw"), F.col("total_revenue")
    )
    return metrics.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})


@query("select count(*) as rows_without_visitor from events where user_id = 3")
def rows_without_visitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that evaluation leaves out."""
    return visitors_missing(scored_events(spark, sf_dir))


def _report_sql(section: str, source: str, p: str, a: str) -> str:
    return f"""
        select '{section}' as section, metric, value
        from (unpivot (select * replace (n::double as n) from ({_metrics_sql(source, p, a)}))
              on n, rmse, mae, r2 into name metric value value)
    """


@query(
    _report_sql("validation", SCORED_SQL, "raw", "total_revenue")
    + " union all "
    + _report_sql("test", VISITORS_SQL, "p", "a")
)
def evaluation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation per row and test per visitor, written and read as a report."""
    scored = scored_events(spark, sf_dir)
    validation = scored.select("fullVisitorId", "total_revenue", F.col("raw").alias(PREDICTION))
    report = evaluation_report(validation, scored).withColumn("value", F.round("value", 6))
    path = new_table_path(spark, "report")
    write_report(report, path)
    return spark.read.schema("section string, metric string, value double").csv(path, header=True)


@query("""
    select cast(event_id as string) as event_id, event_type, value, cast(null as string) as props
    from events where user_id < 75
    union all
    select cast(event_id as string), null, cast(user_id as double), props from events where user_id >= 75
""")
def union_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with other columns and types as one table."""
    events = table(spark, sf_dir, "events")
    first = events.filter("user_id < 75").select("event_id", "event_type", "value")
    second = events.filter("user_id >= 75").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("value"), "props"
    )
    return union_relaxed(first, second)


@query("""
    select cast(event_id as string) as event_id, value, cast(null as bigint) as user_id
    from events where user_id < 75
    union all select cast(event_id as string), value, user_id from events where user_id >= 75
""")
def folder_of_mixed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose parquet parts disagree on a type."""
    path = new_table_path(spark, "mixed-parts")
    events = table(spark, sf_dir, "events")
    events.filter("user_id < 75").select("event_id", "value").write.parquet(path)
    events.filter("user_id >= 75").select(
        F.col("event_id").cast("string").alias("event_id"), "value", "user_id"
    ).write.mode("append").parquet(path)
    return read_parts_relaxed(spark, path)


@query("""
    select cast(c_custkey as string) as "fullVisitorId", c_custkey as "visitNumber",
           case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as segment,
           '[{''index'': "4", ''value'': ''' || c_name || ', x''}]' as dimension
    from customer
""")
def csv_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table to CSV with quoted cells, back with typed columns, through parquet."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("fullVisitorId"),
        F.col("c_custkey").alias("visitNumber"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.concat(
            F.lit("[{'index': \"4\", 'value': '"), F.col("c_name"), F.lit(", x'}]")
        ).alias("dimension"),
    )
    csv, parquet = new_table_path(spark, "customer-csv"), new_table_path(spark, "customer")
    write_csv(customer, csv)
    write_table(read_sessions_csv(spark, csv), parquet)
    return read_table(spark, parquet)


@query("""
    select cast(n as bigint) as "rows", cast(count(*) as bigint) as parts
    from (select least(1000, total - 1000 * i) as n
          from (select count(*) as total from orders), unnest(range((total + 999) // 1000)) as t(i))
    group by n
""")
def rows_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parquet parts have how many rows; one writer, at most 1000 rows a part."""
    path = new_table_path(spark, "orders")
    write_table(table(spark, sf_dir, "orders").coalesce(1), path, rows_per_file=1000)
    return rows_per_part(spark, path).groupBy("rows").agg(F.count(F.lit(1)).alias("parts"))


@query(ENCODED_SQL)
def stored_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary stored as a version, loaded again and applied."""
    path = new_table_path(spark, "parameters")
    save_version(spark, {"columns": {}}, path)
    save_version(spark, category_dictionary(spark, sf_dir), path)
    return encode_categories(category_table(spark, sf_dir), load_version(spark, path))


def _rank_sql(c: str) -> str:
    return f"""
        (select {c}, row_number() over (order by r) + 1 as i
         from (select {c}, row_number() over (order by count(*) desc, {c}) as r from clean group by 1)
         where r <= 15 and {c} <> '')
    """


def _index_sql(c: str) -> str:
    # 'unknown' is a reserved text and is not retained.
    ranks = _rank_sql(c).replace("<> ''", "not in ('', 'unknown')")
    return f"""
        cast(case {c} when '' then 0 when 'unknown' then 1
             else coalesce((select i from {ranks} k where k.{c} = t.{c}),
                           (select count(*) + 2 from {ranks})) end as bigint) as {c}
    """


LOGGED = ["total_revenue", "total_product_viewed", "total_category_viewed", "totals_hits", "totals_pageviews",
          "average_price_product_viewed", '"visitNumber"']
CALENDAR = """
    date_part('isodow', strptime(date::varchar, '%Y%m%d'))::int - 1 as date_dow,
    date_part('month', strptime(date::varchar, '%Y%m%d'))::int as date_month,
    (date_part('isodow', strptime(date::varchar, '%Y%m%d')) >= 6)::int as date_is_weekend,
    date_part('hour', to_timestamp("visitStartTime") at time zone 'UTC')::int as vst_hour,
    date_part('isodow', to_timestamp("visitStartTime") at time zone 'UTC')::int - 1 as vst_dow,
    (date_part('isodow', to_timestamp("visitStartTime") at time zone 'UTC') >= 6)::int as vst_is_weekend
"""
CODED = ["channelGrouping", "customDimensions", "device_browser", "device_isMobile", "geoNetwork_country",
         "trafficSource_adwordsClickInfo_page", "categories_viewed_0", "categories_viewed_1",
         "categories_viewed_2"]
SINGLE_VALUED = ["socialEngagementType", "trafficSource_source"]


def _model_sql(coded: list[str], rest: str = "") -> str:
    """Model input of the clean sessions, with logs rounded to 6 places."""
    capped = {"total_product_viewed": "p", "average_price_product_viewed": "a"}
    logs = [f"round(ln(1 + {f'least({c}, {capped[c]})' if c in capped else c}), 6) as {c}" for c in LOGGED]
    return f"""
        with clean as ({CLEAN}),
             caps as (select quantile_cont(total_product_viewed, 0.99) as p,
                             quantile_cont(average_price_product_viewed, 0.99) as a from clean)
        select "fullVisitorId", "visitId", {", ".join(logs)}, {CALENDAR},
               {", ".join(_index_sql(c) for c in coded)} {rest}
        from clean t, caps
    """


def logs_rounded(features: DataFrame) -> DataFrame:
    return features.withColumns({c.strip('"'): F.round(c.strip('"'), 6) for c in LOGGED})


MODEL_INPUT_SQL = _model_sql([*CODED, *SINGLE_VALUED], ", totals_visits")


@query(MODEL_INPUT_SQL)
def model_input_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sessions through the fitted pipeline to the model input, all columns."""
    _, result = fit_transform(event_sessions(spark, sf_dir))
    return logs_rounded(result)


@query(_model_sql(CODED))
def saved_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline with data-driven drops, saved, loaded and applied; all columns that are left."""
    raw = event_sessions(spark, sf_dir)
    path = new_table_path(spark, "pipeline")
    fit_pipeline(raw, drop_low_variance=True).save(spark, path)
    return logs_rounded(FittedPipeline.load(spark, path).transform(raw))


@query("""
    select 'device' as source, unnest(['browser', 'browserSize', 'isMobile']) as path
    union all select 'geoNetwork', 'country'
    union all select 'totals', unnest(['hits', 'pageviews', 'totalTransactionRevenue',
                                       'transactionRevenue', 'visits'])
    union all select 'trafficSource', unnest(['adwordsClickInfo.page', 'source'])
""")
def discovered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found in the JSON cells of the whole table."""
    leaves = discover_leaves(event_sessions(spark, sf_dir))
    rows = [(leaf.source, ".".join(leaf.path)) for leaf in leaves]
    return spark.createDataFrame(rows, "source string, path string")


@query("""
    with fit as (select regr_slope(l_extendedprice, l_quantity) as b,
                        regr_intercept(l_extendedprice, l_quantity) as a from lineitem)
    select l_orderkey, l_linenumber, round(greatest(a + b * l_quantity, 0), 3) as "PredictedLogRevenue"
    from lineitem, fit
""")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear regression fitted and applied."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("total_revenue")
    )
    model = fit_regressor(lines, ["l_quantity"], kind="linear")
    return score(model, lines).select(
        "l_orderkey", "l_linenumber", F.round(PREDICTION, 3).alias(PREDICTION)
    )


@query("""
    with test as (select l_orderkey, ln(1 + l_extendedprice) as y from lineitem where l_orderkey % 5 = 0),
         train as (select ln(1 + l_extendedprice) as y from lineitem where l_orderkey % 5 <> 0)
    select 'train' as section, (select count(*) from train) as "rows", (select count(*) from train) as groups,
           true as no_negative, true as better_than_mean
    union all
    select 'test', (select count(*) from test), (select count(distinct l_orderkey) from test), true, true
""")
def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees with the engine's own settings, on training rows and on visitors held out.

    Trees have no closed form in SQL; what SQL can state is stated: every row and visitor has a prediction, none
    is negative after the floor, and the errors are smaller than those of the mean.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_orderkey").cast("string").alias("fullVisitorId"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("visitId"),
        F.log1p("l_extendedprice").alias("total_revenue"),
        "l_quantity",
        "l_discount",
        "l_tax",
    )
    held_out = F.col("l_orderkey") % 5 == 0
    train, test = (rows.where(c).drop("l_orderkey") for c in (~held_out, held_out))
    training = train_and_evaluate(train, test)
    prepared = apply_prep(train, training.prep)
    fitted = score(training.model, prepared)
    visitors = visitor_table(score(training.model, apply_prep(test, training.prep)))
    sections = []
    for name, scored, actual in (("train", fitted, "total_revenue"), ("test", visitors, "actual")):
        stats = scored.agg(
            F.count(PREDICTION).alias("rows_or_visitors"),
            (F.min(PREDICTION) >= 0).alias("no_negative"),
            (
                F.avg((F.col(PREDICTION) - F.col(actual)) ** 2) < F.var_pop(actual)
            ).alias("better_than_mean"),
        )
        n_rows = fitted.count() if name == "train" else test.count()
        sections.append(
            stats.select(
                F.lit(name).alias("section"),
                F.lit(n_rows).cast("bigint").alias("rows"),
                F.col("rows_or_visitors").alias("groups"),
                "no_negative",
                "better_than_mean",
            )
        )
    return sections[0].unionByName(sections[1])


LINEAR_SQL = f"""
    with every as ({SPLIT_SQL}),
         rows as (select * replace (row_number() over (order by visitId) as rn, count(*) over () as n)
                  from every where visitor % 4 <> 0),
         fit as (select regr_slope(total_revenue, visitor) as b, regr_intercept(total_revenue, visitor) as a
                 from rows where rn <= floor(n * 0.9)),
         val as (select total_revenue, a + b * visitor as p from rows, fit where rn > floor(n * 0.9)),
         visitors as (select fullVisitorId, sum(total_revenue) as a, sum(greatest(a + b * visitor, 0)) as p
                      from every, fit where visitor % 4 = 0 group by 1)
"""


@query(
    LINEAR_SQL
    + _report_sql("validation", "select * from val", "p", "total_revenue")
    + " union all "
    + _report_sql("test", "select * from visitors", "p", "a")
)
def linear_training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, preparation, linear fit and both evaluations; a quarter of the visitors is held out for the test."""
    rows = event_rows(spark, sf_dir).select("fullVisitorId", "visitId", "total_revenue", "visitor")
    held_out = F.col("visitor") % 4 == 0
    report = train_and_evaluate(rows.where(~held_out), rows.where(held_out), kind="linear").report
    return report.withColumn("value", F.round("value", 6))


def small_net() -> DenseNet:
    """A small net with fixed weights in the place of a trained one."""
    return DenseNet(
        numeric=["l_quantity", "l_discount"],
        embeddings={"l_linenumber": np.array([[0.5, -0.5], [0.25, 0.125], [-1.0, 2.0]])},
        layers=[
            DenseLayer(
                weight=np.array([[0.5, 0.25, 0.125, 2.0], [-0.5, 1.0, 0.0625, -4.0]]),
                bias=np.array([0.1, -0.2]),
                gamma=np.array([1.5, 0.75]),
                beta=np.array([0.05, 0.3]),
                running_mean=np.array([2.0, 1.0]),
                running_var=np.array([4.0, 0.25]),
            )
        ],
        out_weight=np.array([0.8, -0.3]),
        out_bias=0.4,
    )


@query("""
    with x as (select l_orderkey, l_linenumber, l_partkey, l_quantity as q, l_discount as d,
                      [0.5, 0.25, -1.0][least(l_linenumber, 2) + 1]::double as e0,
                      [-0.5, 0.125, 2.0][least(l_linenumber, 2) + 1]::double as e1 from lineitem),
         h as (select *, greatest((0.5::double * e0 + 0.25::double * e1 + 0.125::double * q + 2.0::double * d
                                   + 0.1::double - 2) * 1.5::double / sqrt(4.00001::double) + 0.05::double, 0) as h0,
                         greatest((-0.5::double * e0 + e1 + 0.0625::double * q - 4.0::double * d
                                   - 0.2::double - 1) * 0.75::double / sqrt(0.25001::double) + 0.3::double, 0) as h1
               from x)
    select l_orderkey, l_linenumber, l_partkey,
           round(greatest(0.8::double * h0 - 0.3::double * h1 + 0.4::double, 0), 6) as "PredictedLogRevenue"
    from h
""")
def dense_net_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scoring of a net with embeddings, batch norm and relu."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    scored = score_dense(lines, small_net(), keys, dtype=np.float64)
    return scored.withColumn(PREDICTION, F.round(PREDICTION, 6))


ONE_HOT_SQL = f"""
    with every as (select e.*, event_type from ({SPLIT_SQL}) e join events on visitId = event_id::varchar),
         rows as (select * replace (row_number() over (order by visitId) as rn, count(*) over () as n)
                  from every where visitor % 4 <> 0),
         fit as (select event_type, avg(total_revenue) as p from rows where rn <= floor(n * 0.9) group by 1),
         val as (select total_revenue, p from rows join fit using (event_type) where rn > floor(n * 0.9)),
         visitors as (select fullVisitorId, sum(total_revenue) as a, sum(greatest(p, 0)) as p
                      from every join fit using (event_type) where visitor % 4 = 0 group by 1)
"""


@query(
    f"select section, metric, round(value, 4) as value from ({ONE_HOT_SQL}"
    + _report_sql("validation", "select * from val", "p", "total_revenue")
    + " union all "
    + _report_sql("test", "select * from visitors", "p", "a")
    + ")"
)
def one_hot_training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted vocabulary, one-hot into a sparse linear fit: it predicts the mean of each category."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("visitId"), F.col("event_type").alias("kind"))
    rows = event_rows(spark, sf_dir).select("fullVisitorId", "visitId", "total_revenue", "visitor").join(events, "visitId")
    dictionary = fit_vocabulary(rows, ["kind"])
    coded = encode_categories(rows, dictionary)
    parts = [coded.where(c).drop("visitor") for c in (F.col("visitor") % 4 != 0, F.col("visitor") % 4 == 0)]
    fit = {"kind": "linear", "indices": vocab_sizes(dictionary), "tol": 1e-12, "maxIter": 500}
    return train_and_evaluate(*parts, **fit).report.withColumn("value", F.round("value", 4))


@query("""
    with rows as (select event_id, event_type, case when event_type <> 'error' then event_id % 7 end as place, user_id from events),
         prep as (select avg(user_id) as m, stddev_pop(user_id) as s from rows where event_type <> 'view'),
         inputs as (select event_id, [[0.5, -0.5], [0.25, 0.125], [-1.0, 2.0], [1.5, 0.5], [0.0, 1.0]][1 + least(4, coalesce(place, 0))] as e,
                           0.75 as f, greatest(-10, least(10, (user_id - m) / s)) as x from rows, prep),
         hidden as (select event_id, greatest(0, ((0.5 * e[1] + 0.25 * e[2] + 0.125 * f + 2 * x + 0.1) - 0.5) / sqrt(4 + 1e-5) * 1.5 + 0.05) as h1,
                           greatest(0, ((-0.5 * e[1] + e[2] + 0.0625 * f - x - 0.2) - 0.25) / sqrt(0.25 + 1e-5) * 0.75 + 0.3) as h2 from inputs)
    select cast(event_id as string) as "visitId", round(greatest(0, 0.8 * h1 - 0.3 * h2 + 0.4), 6) as "PredictedLogRevenue" from hidden
""")
def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation of numbers and category indices, one category column absent, into a net with embeddings."""
    place = F.when(F.col("event_type") != "error", F.col("event_id") % 7)
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("visitId"), "event_type", F.col("user_id").alias("visitor"), place.alias("place")
    )
    prep = fit_prep(rows.where("event_type <> 'view'"), ["visitor", "place"], indices={"place": 5, "absent": 3})
    net = DenseNet(
        numeric=["visitor"],
        embeddings={
            "place": np.array([[0.5, -0.5], [0.25, 0.125], [-1.0, 2.0], [1.5, 0.5], [0.0, 1.0]]),
            "absent": np.array([[0.75], [9.0], [9.0]]),
        },
        layers=[
            DenseLayer(
                weight=np.array([[0.5, 0.25, 0.125, 2.0], [-0.5, 1.0, 0.0625, -1.0]]),
                bias=np.array([0.1, -0.2]),
                gamma=np.array([1.5, 0.75]),
                beta=np.array([0.05, 0.3]),
                running_mean=np.array([0.5, 0.25]),
                running_var=np.array([4.0, 0.25]),
            )
        ],
        out_weight=np.array([0.8, -0.3]),
        out_bias=0.4,
    )
    scored = score_dense(apply_prep(rows, prep, ["visitId"]), net, ["visitId"], dtype=np.float64)
    return scored.withColumn(PREDICTION, F.round(PREDICTION, 6))


@query("""
    select count(*) as rows, true as loss_falls, true as below_spread, true as repeats from events
""")
def net_training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A net fitted twice by distributed gradient steps: its loss falls below the labels' spread, and both fits are equal."""
    rows = event_rows(spark, sf_dir).withColumn("total_revenue", F.col("total_revenue") + 10 * (F.col("visitor") % 3))
    rows = rows.withColumn("group", F.col("visitor") % 3)
    prep = fit_prep(rows, ["spend"], indices={"group": 3})
    ready = materialize(apply_prep(rows, prep), "net-features")
    fits = [fit_net(ready, prep, hidden=(16,), embedding=2, steps=12, learning_rate=0.1) for _ in range(2)]
    errors = [e for e, _ in fits[0].history]
    scored = score_dense(ready, fits[0].net, ["total_revenue"], floor=False, dtype=np.float64)
    error = F.sqrt(F.avg((F.col(PREDICTION) - F.col("total_revenue")) ** 2))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(errors[-1] < errors[0]).alias("loss_falls"),
        (error < F.stddev_pop("total_revenue")).alias("below_spread"),
        F.lit(fits[0].history == fits[1].history).alias("repeats"),
    )
